import pytest
from biblink.operators import citations as cite
from pyspark.sql import functions as F

FOUND = {
    "aged 45 years and older. 1 According to": ["1"],
    "burden being for knee OA 2.": ["2"],
    "short-lived analgesia 6,7.": ["6,7"],
    "beyond 3 months 6,8.": ["6,8"],
    "As shown [1] and (2, 3) or [4-6].": ["1", "2, 3", "4-6"],
    "better-resourced systems.29-32 Then": ["29-32"],
    "the statement¹·²⁻⁴ holds": ["1,2-4"],
}
IGNORED = ["We saw 25 patients", "By month 1, none", "In Group 4.", "10 mL of it", "change of x²=3", "10³ of these", "p=0.05 here", "counted 4,326 cases", "mean 62.14 here", "at 0.", "for knee 3, 1 and 2"]


@pytest.fixture(scope="module")
def spans(spark):
    texts = [*FOUND, *IGNORED, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.s for r in df.select("t", cite.citation_spans(F.col("t")).alias("s")).collect()}


def test_markers_are_found_in_place(spans):
    for text, specs in FOUND.items():
        assert [s.spec for s in spans[text]] == specs, text
        assert all(text[s.start : s.end].strip("[]()") in (s.spec, "¹·²⁻⁴") for s in spans[text])


def test_prose_is_left_alone(spans):
    for text in IGNORED:
        assert spans[text] == [], text
    assert spans[None] == []


@pytest.mark.parametrize(
    "spec,bracketed,want",
    [("1", False, [1]), ("2,3", False, [2, 3]), ("4-6", False, [4, 5, 6]), ("3-32", False, []), ("3-32", True, list(range(3, 33))), ("0-5", True, []), ("1990-2023", True, []), ("5-3", False, []), ("7, 99, 7", False, [7, 7]), ("1, 3–4", False, [1, 3, 4])],
)
def test_specifications(spark, spec, bracketed, want):
    df = spark.createDataFrame([(spec, bracketed)], "s string, b boolean")
    assert df.select(cite.expand(F.col("s"), F.col("b"), F.sequence(F.lit(1), F.lit(40))).alias("x")).first().x == want


def test_rewriting_deletes_with_the_space(spark):
    markers = F.create_map(*[x for k, v in {1: "{one}", 2: None}.items() for x in (F.lit(k), F.lit(v).cast("string"))])
    df = spark.createDataFrame([("knee OA [2]. Then [1, 2] and [9].",)], "t string")
    out = df.select(cite.rewrite(F.col("t"), cite.citation_spans(F.col("t")), F.array(F.lit(1), F.lit(2)), markers).alias("x")).first().x
    assert out == "knee OA. Then {one} and [9]."


def test_word_superscripts_merge_across_runs(spark):
    runs = [("word", False), ("1", True), (",2", True), (" on", False), ("3", True)]
    df = spark.createDataFrame([("word1,2 on3", runs)], "t string, r array<struct<text:string,superscript:boolean>>")
    got = df.select(cite.run_spans(F.col("r"), F.col("t")).alias("s")).first().s
    assert [(s.start, s.end, s.spec) for s in got] == [(4, 7, "1,2"), (10, 11, "3")]


def test_positions_of_very_many_matches(spark):
    import re

    from biblink.functions.spans import matches

    texts = [None, "", "ab12é3 45", "\U0001f600 7 " * 1500, "x" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    got = {r.n: [tuple(m) for m in r.found] for r in df.select("n", matches(F.col("text"), r"\d+").alias("found")).collect()}
    assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", t or "")] for i, t in enumerate(texts)}
