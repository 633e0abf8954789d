import re
from difflib import SequenceMatcher

from biblink.operators import legacy
from pyspark.sql import functions as F


def brute(raw, author, year, title):
    y = re.search(legacy.YEAR, raw)
    total = SequenceMatcher(None, f"{author} {year} {title}".strip().lower(), raw.lower()).ratio()
    total += 0.25 if author and author.lower() in raw.lower() else -0.20
    total += 0.15 if y and int(y[0]) == year else -0.15
    return max(0.0, min(1.0, total))


def test_best_match_is_the_first_of_the_highest(spark):
    raw = "Roe AB. Wear of steady widgets in rings. J Appl Widget. 2001;3:4-9."
    cands = [(1, "Doe", 2001, "Wear of steady widgets", "10.1/a"), (2, "Roe", 2001, "Wear of steady widgets in rings", "10.1/b"), (3, "Roe", 2001, "Wear of steady widgets in rings", "10.1/c"), (4, "", None, "", None)]
    df = spark.createDataFrame([(1, raw, *c) for c in cands] + [(2, "Quite other words", *cands[0])], "n int, raw string, arrival int, author string, year int, title string, doi string")
    got = {r.n: r for r in legacy.best_match(df, ["n"]).collect()}
    assert (got[1].doi, got[1].ok) == ("10.1/b", True) and got[1].score == round(brute(raw, "Roe", 2001, cands[1][3]), 2)
    assert not got[2].ok and got[2].score == round(brute("Quite other words", "Doe", 2001, cands[0][3]), 2)
    scored = df.withColumn("s", legacy.score(F.col("raw"), F.col("author"), F.col("year"), F.col("title"), legacy.sequence_ratio(F.lower(legacy.rebuilt(F.col("author"), F.col("year"), F.col("title"))), F.lower("raw"))))
    for r in scored.collect():
        assert abs(r.s - brute(r.raw, r.author, r.year, r.title or "")) < 1e-12


def test_unnumbered_lists_and_hints(spark):
    lines = spark.createDataFrame([("d", 1, " first one"), ("d", 2, ""), ("d", 3, "second")], "doc_id string, line_no int, text string")
    assert sorted((r.n, r.raw) for r in legacy.segment(lines).collect()) == [(1, "first one"), (2, "second")]
    author, year = legacy.hint(F.col("raw"))
    df = spark.createDataFrame([("  O'Neil-Roe X. 1850, 1999 and 2004",), ("lower 12",)], "raw string").select(author.alias("a"), year.alias("y"))
    assert [tuple(r) for r in df.collect()] == [("O'Neil-Roe", 1999), (None, None)]
