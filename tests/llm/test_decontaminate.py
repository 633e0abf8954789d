import random

import numpy as np
from biblink.llm import decontaminate as decontamination
from biblink.llm.decontaminate import FMIndex, Phrases, contamination, contamination_report, decontaminate, suffix_array

from . import brute


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_suffix_array_and_index():
    rng = np.random.default_rng(5)
    for n, sigma in ((1, 3), (40, 3), (300, 4), (500, 60)):
        text = rng.integers(1, sigma, n)
        text = np.r_[text, text[: n // 2]]
        assert suffix_array(np.r_[text, 0]).tolist() == sorted(range(len(text) + 1), key=lambda i: [*text[i:], 0])
        index = FMIndex(text, sigma)
        for length in (1, 2, 5):
            phrases = np.array([text[i : i + length] for i in range(len(text) - length + 1)][:50] + [rng.integers(1, sigma, length)])
            for phrase, low, high in zip(phrases, *index.search(phrases)):
                want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == phrase).all()]
                assert sorted(index.locate(np.arange(low, high))) == want


def test_documents_against_brute_force(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda df: [tuple(r)[:2] for r in df.collect()]
    want = sorted(brute.contamination(plain(docs), plain(bench)))
    assert any(r[-1] for r in want)
    assert rows(contamination_report(contamination(docs, bench))) == want
    assert rows(contamination_report(contamination(docs, bench, shard_words=500))) == want


def small():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "c1", "É", "straße"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 14])))) for i in range(12)] + [(50, None), (51, "!?")]
    docs = [(i, ". ".join(word() for _ in range(rng.choice([0, 3, 30])))) for i in range(40)] + [(100, None), (101, "")]
    return docs + [(i + 200, f"x {t}, {t.upper()} y") for i, t in items if t], items


def test_parts_of_a_large_benchmark_agree(spark):
    docs, items = small()
    d = spark.createDataFrame([(i, t, 0, "") for i, t in docs], "doc_id long, text string, row int, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(docs, items))
    assert rows(contamination_report(contamination(d, b))) == want
    assert rows(contamination_report(contamination(d, b, part_words=20))) == want
    for limit in (1 << 20, 20):
        clean = decontaminate(d, b, part_words=limit)
        assert clean.columns == d.columns and clean.count() == len(docs)
        hits = {r[0]: r for r in want}
        for r in clean.collect():
            n = len(brute.WORD.findall(brute.lower(r.text)))
            assert n == hits[r.doc_id][1] - hits[r.doc_id][2]


def test_empty_tables(spark):
    docs, items = small()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert all(not r.contaminated for r in contamination_report(contamination(d, b.limit(0))).collect())
    assert contamination_report(contamination(d.limit(0), b)).collect() == []
    assert rows(decontaminate(d.where("text is not null"), b.limit(0))) == sorted((i, t) for i, t in docs if t is not None)


def test_pieces_hold_every_window_and_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WINDOWS", 7)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([1, 9, 10, 11, 25, 60])))) for i in range(30)]
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(400))) for i in range(6)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pieces = decontamination._pieces(b, "item_id", "text", 10)
    parts = [Phrases.of(p.value) for p in decontamination._shared_parts(pieces, 10, 100)]
    assert len(parts) > 3 and all(sum(len(w) for w, _, _ in p.by_length.values()) < 300 for p in parts)
    want = sorted(brute.contamination(docs, items))
    for part_words in (10**6, 100):
        assert rows(contamination_report(contamination(d, b, part_words=part_words))) == want


def test_columns_of_any_name_come_back(spark):
    names = ["row", "_row", "kept", "spans", "c0", "a.b", "Text 2"]
    d = spark.createDataFrame([("p", "x", *range(7)), (None, "y", *range(7))], ", ".join(["text string", "doc_id string", *(f"`{n}` int" for n in names)]))
    b = spark.createDataFrame([(1, "P")], "item_id long, text string")
    for part_words in (100, 1):
        got = decontaminate(d, b, part_words=part_words)
        assert got.columns == d.columns and sorted(map(tuple, got.collect()), key=str) == [("", "x", *range(7)), (None, "y", *range(7))]
