import zlib

import numpy as np
import pytest
from biblink.llm.langid import has_letter, language_id, windows
from biblink.llm.linear import Rows, fit
from biblink.llm.quality import keep_good, path_posteriors, quality
from biblink.llm.toxicity import SWAPS, features, toxicity, train

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache(), spark.read.parquet(f"{SF}/labels.parquet").cache()


def in_fold(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def held_out_accuracy(rows, truth, predicted):
    judged = [(truth[r.doc_id], predicted(r)) for r in rows if r.held_out and r.doc_id in truth]
    assert len(judged) > 100
    return [np.mean([p == y for t, p in judged if t == y]) for y in sorted({t for t, _ in judged}, key=str)]


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == in_fold(r.doc_id, 5, 0) for r in rows)
    clean, toxic = held_out_accuracy(rows, {r.doc_id: r.toxic for r in labels.collect()}, lambda r: r.predicted)
    assert clean > 0.99 and toxic > 0.85


def test_identity_terms_carry_less_with_the_penalty():
    rng = np.random.default_rng(1)
    examples = []
    for i in range(400):
        y = int(i % 4 == 0)
        words = {f"w{x}".encode() for x in rng.integers(0, 40, 8)} | ({b"idiot"} if y and i % 3 else set())
        # toxic rows of the sample name one group far more often
        words |= {b"muslims"} if rng.random() < (0.8 if y else 0.05) else {b"christians"} if rng.random() < 0.3 else set()
        swapped = [SWAPS.get(w, w) for w in words]
        examples.append((features(words), features(swapped) if set(swapped) != words else None, y))
    term = int(features([b"muslims"])[0])
    other = int(features([b"jews"])[0])
    gap = {}
    chosen = np.unique(np.concatenate([e[0] for e in examples]))
    for fairness in (0.0, 50.0):
        weights, _ = train(examples, chosen, fairness)
        gap[fairness] = abs(weights.get(term, 0.0) - weights.get(other, 0.0))
    assert gap[50.0] < 0.2 * gap[0.0]


def test_fit_separates():
    rows = Rows([np.array([i % 2, 2]) for i in range(40)])
    w, b = fit(rows, np.array([i % 2 for i in range(40)], float), 3)
    assert w[1] + w[2] + b > 2 > -2 > w[0] + w[2] + b


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count()
    bad, good = held_out_accuracy(rows, {r.doc_id: r.quality for r in labels.collect()}, lambda r: int(r.keep))
    assert good > 0.99 and bad > 0.9
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if r.keep}


def test_sparse_sites_are_shrunk(spark):
    rows = [("good", "a", 3.0)] * 400 + [("bad", "a", -3.0)] * 400 + [("tiny", "a", -3.0)] + [(None, "b", 3.0)] * 5
    got = {r.host: r for r in path_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.0).collect()}
    assert got["good"].path_posterior > 0.9 and got["bad"].path_posterior < 0.1
    assert got["bad"].host_posterior < got["tiny"].host_posterior < 0.5
    assert set(got) == {"good", "bad", "tiny", None}


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    rows = language_id(docs).collect()
    assert len(rows) == docs.count() and all(r.held_out == in_fold(r.doc_id, 4, 2) for r in rows)
    assert min(held_out_accuracy(rows, {r.doc_id: r.lang for r in docs.collect()}, lambda r: r.lang_pred)) > 0.97


def test_windows_cover_the_whole_text():
    text = bytes(range(1, 256)) * 5
    assert windows(text).tobytes().rstrip(b"\0") == text and windows(b"").shape[0] == 1
    assert has_letter("ß".encode()) and not has_letter("12 — ☃".encode()) and not has_letter(b"")


def test_odd_inputs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, evidence string, y int, language int"
    docs = spark.createDataFrame([(1, None, "en", "s"), (2, "", None, None), (3, "12 34", "de", "s"), (None, "the words", "en", "s"), (5, "der die das " * 20000, "de", None), (5, "the", "en", "s")], schema.split(", n_chars")[0]).selectExpr("*", "1L n_chars", "1 row", "'' evidence", "2 y", "3 language")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        assert len(toxicity(docs, some).collect()) == 6
        assert len(quality(docs, some).collect()) == 6
        assert keep_good(docs, some).columns == docs.columns
        assert toxicity(docs.limit(0), some).collect() == quality(docs.limit(0), some).collect() == []
    found = language_id(docs).collect()
    assert [r.lang_pred == "und" for r in sorted(found, key=lambda r: (r.doc_id or 4, r.score))][:3] == [True] * 3
    assert {r.lang_pred for r in found} <= {"en", "de", "und"}
    assert language_id(docs.limit(0)).collect() == []
