import random

from biblink.llm import simhash
from biblink.llm.components import connected_components
from biblink.llm.simhash import LISTS, MIN_MEETINGS, fingerprint, fingerprint_links, keep_one_of_each, masked_links, near_duplicates

import numpy as np

from . import brute


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_fewest_meetings_of_a_pair_within_the_limit():
    for shared in range(9):
        meetings = sum(set(positions) <= set(range(shared)) for positions in LISTS)
        assert (meetings >= MIN_MEETINGS) == (shared >= 5)


def test_masked_links_connect_what_is_close():
    rng = random.Random(5)
    fixed = rng.getrandbits(40) << 24
    for values in ({fixed | rng.getrandbits(24) for _ in range(300)}, {fixed ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) for _ in range(90)}, {fixed, fixed ^ 1}, {fixed, fixed ^ 15}):
        listed = sorted(values)
        links = masked_links(np.array(listed, np.uint64))
        assert len(links) < len(listed) and all((listed[i] ^ listed[j]).bit_count() <= 3 for i, j in links)
        want = brute.components(listed, [(a, b) for a in listed for b in listed if (a ^ b).bit_count() <= 3])
        assert brute.components(listed, [(listed[i], listed[j]) for i, j in links]) == want


def test_fingerprint_counts_repeats():
    for text in ["", "a", "A b", "a b c", "x y z x y z x y z q", "É é straße\tb\x0bc\x1cd e"]:
        assert fingerprint(text.encode()) == brute.simhash(text)


def test_fingerprint_of_blocks(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abC \n\t\x1c") for _ in range(n)) for n in (0, 1, 5, 40, 300)] + ["x" * 90, "ab " * 70, " " * 50]
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "_BLOCK_BYTES", size)
        assert [fingerprint(t.encode()) for t in texts] == [brute.simhash(t) for t in texts]


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows(near_duplicates(docs)) == brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()])


def test_links_connect_what_is_close_in_short_and_long_lists(spark):
    rng = random.Random(3)
    values = {0, 2**64 - 1}
    for centre in (rng.getrandbits(64) for _ in range(4)):
        values |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)}
        chain = centre
        for _ in range(6):
            for _ in range(3):
                chain ^= 1 << rng.randrange(64)
            values.add(chain)
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    want = brute.components(signed.values(), [(signed[a], signed[b]) for a in values for b in values if (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    for long_list in (64, 6, 2):
        got = dict.fromkeys(signed.values())
        got.update({v: v for v in got})
        got.update({r.node: r.root for r in connected_components(fingerprint_links(df, long_list)).collect()})
        assert got == want


def test_nulls_empties_repeats_and_clashing_columns(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (9, "w " * 5000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, fp int, root int")
    got = sorted(near_duplicates(df).collect(), key=str)
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[1].fingerprint == "0" * 16
    assert by_id[None].component_id == by_id[5].component_id == 5
    assert near_duplicates(df.limit(0)).collect() == []


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    words = lambda w: " ".join(f"{w}{i}" for i in range(60))
    docs = [(1, words("a")), (None, words("a")), (None, words("b")), (None, words("b")), (None, words("c")), (5, words("a")), (5, words("d")), (7, words("e")), (7, words("f")), (9, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, keep_one_of_each(df).collect()), key=str)
    want = [(1, words("a")), (None, words("b")), (None, words("c")), (5, words("d")), (7, words("e")), (7, words("f")), (9, None)]
    assert got == sorted(want, key=str)


def test_survivors_keep_columns_of_any_name(spark):
    clash = ["_stays", "_row", "_row_key", "key", "stays", "row", "_text", "fp"]
    docs = [(i, t, *(f"{c}{i}" for c in clash)) for i, t in [(1, "a b c d"), (2, "a b c d"), (3, "e f g h"), (None, None)]]
    df = spark.createDataFrame(docs, ", ".join(["doc_id long", "text string", *(f"{c} string" for c in clash)]))
    got = keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((docs[0], docs[2], docs[3]), key=str)
    assert keep_one_of_each(df.limit(0)).collect() == []
