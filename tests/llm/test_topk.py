import math
import random

from biblink.llm.topk import _intervals, exact_top_k


def brute(vectors, k, divisor):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: min(v for j, v in ints if j == i) for i, _ in ints if i % divisor == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_embeddings_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert rows(exact_top_k(df, query_divisor=20)) == brute([(r.vec_id, r.embedding) for r in df.collect()], 10, 20)


def test_ties_gaps_and_bad_vectors(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.choice([-1.5, 0.0, 0.25, 3.0]) for _ in range(3)]) for i in range(60)]
    vectors += [(i, [1.0, 1.0, 1.0]) for i in range(60, 140)]
    vectors += [(200, None), (201, [None, 1.0, 1.0]), (202, [math.nan, 1.0, 1.0]), (203, [math.inf, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (205, []), (206, [5.0])]
    vectors += [(70, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in vectors], "vec_id long, embedding array<double>, id int, v int")
    for k, bins in ((10, 1024), (3, 4)):
        assert rows(exact_top_k(df, k, 10, bins=bins)) == brute(vectors, k, 10)


def test_large_numbers_stay_exact(spark):
    vectors = [(i, [2.0**20 + i / 1024, -(2.0**19) + i]) for i in range(30)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows(exact_top_k(df, 4, 10)) == brute(vectors, 4, 10)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0])], "vec_id long, embedding array<float>")
    assert rows(exact_top_k(df)) == {(0, 1, 100, 2 << 20), (100, 1, 0, 2 << 20)}
    assert exact_top_k(df.limit(0)).collect() == []
    assert exact_top_k(df.where("vec_id = 0")).collect() == []


def test_many_small_groups_and_few_bins(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.randint(-40, 40) / 32 for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows(exact_top_k(df, 6, 15, bins=3, group_bytes=256)) == brute(vectors, 6, 15)


def test_intervals_narrow_to_one_score():
    for span in (1, 2, 7, 4096, 4097, 2 * 2**20 + 1, 2**63):
        passes, bins = _intervals(span, 4096)
        assert bins <= 4096 and bins**passes >= span
