from collections import Counter

import corpus_pipeline
from biblink.llm.common import cut
from biblink.llm.quality import quality

from . import brute

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, dtypes = docs.columns, docs.dtypes
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scan", "source mixing"]
    texts = {r.doc_id: r.text for r in docs.collect()}

    def step(name, given):
        out = cut(stages[name](spark, given, SF), "test")
        assert out.columns == columns and out.dtypes == dtypes
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count() and all(r.n_chars == len(r.text) for r in rows.values())
        return out, {i: r.text for i, r in rows.items()}

    good, kept = step("quality classifier", docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert set(kept) == {r.doc_id for r in quality(docs, labels).where("keep").collect()} and 0 < len(kept) < len(texts)
    assert all(kept[i] == texts[i] for i in kept)

    single, left = step("simhash near-dedup", good)
    assert set(left) == {c for _, _, c in brute.near_duplicates(kept.items())}

    clean, cleaned = step("benchmark decontamination", single)
    hits = {r[0]: r for r in brute.contamination(left.items(), bench)}
    assert set(cleaned) == set(left) and any(h[-1] for h in hits.values())
    for i, h in hits.items():
        assert len(brute.WORD.findall(brute.lower(cleaned[i]))) == h[1] - h[2]
        assert h[-1] or cleaned[i] == left[i]

    safe, redacted = step("secret scan", clean)
    assert set(redacted) == set(cleaned)
    for i, t in redacted.items():
        assert not brute.base_secrets(t)
        assert brute.base_secrets(cleaned[i]) or "[SECRET]" in t or t == cleaned[i]

    mixed = stages["source mixing"](spark, safe, SF).collect()
    epochs = Counter((r.doc_id, r.epoch) for r in mixed)
    assert set(epochs.values()) == {1} and {r.doc_id for r in mixed} <= set(redacted)
    assert all(r.n_tokens == len(brute.BLANK_WORD.findall(redacted[r.doc_id])) for r in mixed)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, mixed))


def test_stages_on_nulls_repeats_clashing_columns_and_empty_tables(spark):
    small = "/root/testdata/sf0.001"
    names = ["_stays", "_row", "_redact_key", "key", "row", "spans", "evidence", "c0", "a.b"]
    plain = spark.read.parquet(f"{small}/documents.parquet").limit(30).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, len(r.text), *names) for r in plain]
    unlike = " ".join(f"Wort{i}, das{i % 7} hier{i % 11} steht." for i in range(400))
    rows += [(None, unlike, None, None, None, *names), (None, None, "en", "s", 0, *names), (900, "", "en", None, 0, *names), rows[0], rows[0], (901, "The long road. " * 40_000, "en", "s", 1, *[None] * len(names))]
    kinds = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{n}` string" for n in names)])
    docs = spark.createDataFrame(rows, kinds)
    for given in (docs, docs.limit(0)):
        left = given
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, left, small), "odd")
            if name != "source mixing":
                assert out.columns == docs.columns and out.count() <= left.count(), name
            left = out
        assert given is docs or left.count() == 0
    single = corpus_pipeline.near_dedup_stage(spark, docs, small).collect()
    assert sum(r.doc_id == rows[0][0] for r in single) <= 1 and sum(r.text == unlike for r in single) == 1
    cleaned = corpus_pipeline.secrets_stage(spark, docs, small).collect()
    assert len(cleaned) == len(rows) and sum(r.text is None for r in cleaned) == 1
