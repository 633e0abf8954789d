import random

from biblink.llm.substrings import level_lengths, remove_repeated
from pyspark.sql import functions as F

from . import brute


def digest(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


def test_levels_at_most_double():
    for w in range(1, 80):
        lengths = level_lengths(w)
        assert lengths[-1] == w and all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:]))


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.substrings(plain)
    assert any(r[2] for r in want)
    assert digest(remove_repeated(docs)) == want
    assert digest(remove_repeated(docs.repartition(5), chunk_bytes=20_000)) == want


def test_small_windows_nulls_and_repeats(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 12, 40])))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, " \n\t"), (103, "q " * 300), (104, "é x\x0by\x1cz"), (None, "p o i u y t"), (105, "p o i u y t"), (105, "p o i u y t")]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in docs], "doc_id long, text string, chunk int, part string")
    for window in (1, 2, 5, 8):
        assert digest(remove_repeated(df, window=window, chunk_bytes=100)) == brute.substrings(docs, window)
    assert remove_repeated(df.limit(0)).collect() == []
