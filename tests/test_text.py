import random
import unicodedata

import pandas as pd
import pytest
from biblink.functions import similarity as sim
from biblink.functions import text as tx
from pyspark.sql import functions as F

STRINGS = ["", "Plain text", "Ünïcode & <i>tags</i> &amp; the An A", "ﬁne ½ x² H₂O №5", "İstanbul ﬀ Ǆ", "naïvé é", "Κάππα ά", "ＡＢＣ１２", "a-b_c.d", None]


def reference_norm(s):
    import re

    s = unicodedata.normalize("NFKC", s or "")
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    s = re.sub(r"&(amp|lt|gt|quot|apos);", " ", re.sub(r"<[^>]+>", " ", s))
    return " ".join(t for t in re.sub(r"[^a-z0-9]+", " ", s).split() if t not in ("the", "a", "an"))


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_norm_text(spark):
    assert column(spark, STRINGS, tx.norm_text) == [reference_norm(s) for s in STRINGS]


def test_surnames(spark):
    names = ["Gupta, Prakash C", "Prakash C Gupta", "Ludwig van der Berg", "Xavier Sala-i-Martin", "Murray CJL", "Öztürk A", "solo", "", None]
    assert column(spark, names, tx.surname_of) == ["gupta", "gupta", "van der berg", "sala-i-martin", "cjl", "a", "solo", "", ""]


def test_dois(spark):
    typed = ["https://doi.org/10.1000/ABC.", "doi: 10.1/x", "10.1234/x.,;", " HTTP://dx.doi.org/10.5555/W ", "", None]
    assert column(spark, typed, tx.norm_doi) == ["10.1000/abc", "10.1/x", "10.1234/x.,;", "10.5555/w", None, None]
    assert column(spark, typed, tx.clean_doi) == ["10.1000/abc", None, "10.1234/x", "10.5555/w", None, None]


def test_two_decimals_round_on_the_binary_value(spark):
    df = spark.createDataFrame([(x,) for x in (0.125, 2.675, 1234.5, 0.0, 0.955)], "x double")
    assert [r.y for r in df.select(tx.fixed2(F.col("x")).alias("y")).collect()] == ["0.12", "2.67", "1234.50", "0.00", "0.95"]


def test_nfkc_composes_typed_marks(spark):
    rng = random.Random(5)
    letters, marks = "aeEounsﬁ½é ạ.ǖ", "\u0301\u0308\u0323\u0327\u0304\u0302\u20e3"
    texts = ["Mu\u0308ller J, E\u0301tude", "e\u0323\u0301 \u00e9\u0323", "\u0301x", "\u09c7\u09be \u0995\u09c7\u09be", "a\u0301\u0301", "plain", "", None]
    texts += ["".join(rng.choice(letters) + "".join(rng.choice(marks) for _ in range(rng.choice([0, 0, 1, 2, 3]))) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert column(spark, texts, tx.nfkc) == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_title_case(spark):
    assert column(spark, ["sala-i-martin", "o'brien VAN"], tx.title_case) == ["Sala-I-Martin", "O'Brien Van"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_dynamic_programming():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert sim.lcs(a, b) == plain_lcs(a, b)


def test_lcs_of_many_pairs_at_once():
    rng = random.Random(11)
    wide = "".join(map(chr, range(0x300, 0x900))) + "\U0001f600"
    for letters, longest, n in (("ab ", 9, 300), ("abcdefghij k", 200, 120), (wide, 130, 60), ("a", 140, 40), ("ab", 3000, 3)):
        a, b = (["".join(rng.choice(letters + more) for _ in range(rng.randrange(longest))) for _ in range(n)] for more in ("", "zé"))
        assert list(sim._lcs_together(a, b)) == [sim.lcs(x, y) for x, y in zip(a, b)]
    got = sim._lcs_column.func(pd.Series(["abc", None, "", "xay"]), pd.Series([None, "b", "x", "a" * 70]))
    assert got.isna().tolist() == [True, True, False, False] and got[2] == 0 and got[3] == 1
    assert len(sim._lcs_column.func(pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0


@pytest.mark.parametrize("a,b,want", [("", "x", 0.0), ("the same", "Same", 1.0), ("renal disease", "renal disease in adults", 1.0), ("abcdefghij", "abcdefghi", 18 / 19)])
def test_title_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert abs(df.select(sim.title_similarity(F.col("a"), F.col("b")).alias("s")).first().s - want) < 1e-12


def test_ratio_keeps_its_order_of_operations(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "")], "a string, b string")
    assert [r.r for r in df.select(sim.ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [(1 - 2 / 6) * 100, 100.0]


def test_similarities_of_many_pairs_are_the_ratios(spark):
    rng = random.Random(13)
    words = "renal disease in adults renal trial of é x2 bolt bolts".split()
    texts = [(i, *(" ".join(rng.choices(words, k=rng.randrange(7))) for _ in "ab")) for i in range(400)] + [(400, " ", "a"), (401, "a", None), (402, None, None), (403, "a  b", "b a"), (404, " ", "  ")]
    df = spark.createDataFrame(texts, "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    plain = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(sim.token_set_ratio(a, b), sim.token_sort_ratio(a, b)) / 100.0)
    rows = df.select(plain.alias("plain"), sim.normalised_similarity(a, b).alias("got"), a.isNull() | b.isNull()).collect()
    assert all(r[0] == r[1] or (r[2] and r[1] is None) for r in rows) and 0 < sum(0 < (r[1] or 0) < 1 for r in rows)
