import math
from collections import Counter, defaultdict

import pytest
from biblink.llm.mixing import mix, source_weights


def totals(spark, tokens):
    return spark.createDataFrame([(s, t, 1) for s, t in tokens.items()], "source string, tokens long, n_rows long")


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def test_weights_meet_the_entropy_or_the_repetition_limit(spark):
    tokens = {"a": 10**6, "b": 10**5, "c": 10**4, "d": 10**3}
    loose = {r.source: r for r in source_weights(totals(spark, tokens), entropy_share=0.7, max_epochs=1e9).collect()}
    assert abs(entropy(r.weight for r in loose.values()) - 0.7 * math.log(4)) < 1e-6
    tight = {r.source: r for r in source_weights(totals(spark, tokens), entropy_share=0.9, max_epochs=3).collect()}
    assert abs(max(r.quota / r.tokens for r in tight.values()) - 3) < 1e-6
    for found in (loose, tight):
        assert abs(sum(r.weight for r in found.values()) - 1) < 1e-9
        a = found["a"].exponent
        assert all(abs(r.weight - tokens[s] ** a / sum(t**a for t in tokens.values())) < 1e-9 for s, r in found.items())
    even = source_weights(totals(spark, {"a": 5, "b": 5}), entropy_share=0.5).collect()
    assert all(r.exponent == 1 and r.weight == 0.5 for r in even)
    assert [r.weight for r in source_weights(totals(spark, {"only": 7})).collect()] == [1.0]


def test_mixture_is_budgeted_block_permutations(spark):
    docs = [(i, "w " * (i % 13 + 1), "big" if i % 10 else f"small{i % 30}") for i in range(3000)] + [(9000, None, "big"), (9001, "", "big"), (9002, "w w", None), (9002, "w w", None), (None, "w", "big")]
    df = spark.createDataFrame([(*d, 0, "") for d in docs], "doc_id long, text string, source string, row int, block string")
    got = mix(df, max_epochs=2.5, block_rows=64).collect()
    assert got == mix(df, max_epochs=2.5, block_rows=64).collect() or sorted(map(str, got)) == sorted(map(str, mix(df, max_epochs=2.5, block_rows=64).collect()))
    tokens, all_tokens = Counter(), 0
    for _, t, s in docs:
        tokens[s] += len((t or "").split())
        all_tokens += len((t or "").split())
    dealt, places = Counter(), defaultdict(list)
    for r in got:
        dealt[r.source] += r.n_tokens
        places[r.source, r.block, r.epoch].append(r.position)
    weight = {r.source: r.weight for r in got}
    for s in tokens:
        blocks = len({b for x, b, _ in places if x == s})
        assert abs(dealt[s] - weight[s] * all_tokens) <= 13 * blocks
        assert weight[s] * all_tokens / tokens[s] <= 2.5 + 1e-6
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert max(len(p) for p in places.values()) < 200
    once = Counter((r.doc_id, r.epoch) for r in got if r.doc_id not in (9002,))
    assert set(once.values()) == {1}
    assert mix(df.limit(0)).collect() == [] and mix(df.where("doc_id in (9000, 9001)")).collect() == []


def test_rows_of_one_id_go_to_all_blocks_and_an_impossible_limit_is_refused(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, "w w", "s") for i in range(2000)], "doc_id long, text string, source string")
    sizes = Counter(r.block for r in mix(df, block_rows=100).collect())
    assert len(sizes) == 20 and max(sizes.values()) < 200 and sum(sizes.values()) == 2000
    with pytest.raises(ValueError):
        mix(df, budget=40_000, max_epochs=4.0)
