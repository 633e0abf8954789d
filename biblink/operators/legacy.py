"""The predecessor's way: one fuzzy score of a whole reference, and text markers.

Kept for manuscripts that were prepared with it.  A reference is compared with a
rebuilt line of each candidate; the best one counts from a threshold on.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.spans import matches
from ..sources.bibliography import HEADING
from .citations import GROUP, SEPARATORS, apply_replacements, expand_plain

# The threshold, the pattern of an entry (its delimiter is needed), of a first
# author, of a year and of superscript digits.
THRESHOLD = 0.55
LEAD = r"^\s*[\[(]?(\d{1,3})[\])\.\)]\s+(.*)$"
AUTHOR = r"^\s*([A-Z][A-Za-z'\-]+)"
YEAR = r"\b(?:19|20)\d{2}\b"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks, longest first, as a share of both texts; null with a null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def split_at_last_heading(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, text, listed)`` of whole manuscripts: what stands after the last heading
    of a reference list is listed; the heading itself goes, and documents without one."""
    last = lines.where(F.col("text").rlike(HEADING)).groupBy("doc_id").agg(F.max("line_no").alias("last"))
    return lines.join(last, "doc_id").where("line_no <> last").select("doc_id", "line_no", "text", (F.col("line_no") > F.col("last")).alias("listed"))


def segment(lines: DataFrame) -> DataFrame:
    """``(doc_id, n, raw)`` of the lines of reference lists; unnumbered ones by their lines."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    lead = F.col("text").rlike(LEAD)
    numbered = lines.where(F.trim("text") != "").select("doc_id", "line_no", "text", lead.alias("lead"))
    marked = numbered.withColumns({"entry": F.sum(F.when(F.col("lead"), 1).otherwise(0)).over(order), "any": F.max("lead").over(W.partitionBy("doc_id")), "place": F.row_number().over(order)})
    text = F.when(F.col("lead"), F.regexp_extract("text", LEAD, 2)).otherwise(F.trim("text"))
    n = F.max(F.when(F.col("lead"), F.regexp_extract("text", LEAD, 1).cast("int"))).alias("n")
    entries = marked.where("any and entry > 0").groupBy("doc_id", "entry").agg(n, F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))).alias("parts"))
    raw = F.trim(F.array_join(F.transform("parts", lambda p: p["t"]), " "))
    listed = entries.select("doc_id", "entry", "n", raw.alias("raw")).groupBy("doc_id", "n").agg(F.max_by("raw", "entry").alias("raw"))
    return listed.unionByName(marked.where("not any").select("doc_id", F.col("place").cast("int").alias("n"), F.trim("text").alias("raw")))


def hint(raw: Column) -> tuple[Column, Column]:
    """A rough first author and year of a reference."""
    return F.nullif(F.regexp_extract(raw, AUTHOR, 1), F.lit("")), F.nullif(F.regexp_extract(raw, YEAR, 0), F.lit("")).cast("int")


def score(raw: Column, author: Column, year: Column, title: Column, similarity: Column) -> Column:
    """0 to 1: the texts' similarity, raised or lowered by the author's name and the year."""
    named = (F.coalesce(author, F.lit("")) != "") & F.contains(F.lower(raw), F.lower(author))
    dated = F.coalesce(year == hint(raw)[1], F.lit(False))
    total = similarity + F.when(named, 0.25).otherwise(-0.20) + F.when(dated, 0.15).otherwise(-0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def rebuilt(author: Column, year: Column, title: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(author, F.lit("")), F.coalesce(year.cast("string"), F.lit("None")), F.coalesce(title, F.lit(""))))


def best_match(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, author, year, title, doi, score, ok)`` of ``pairs(keys, raw, arrival, author, year,
    title, doi)``: the best candidate of each reference, the earliest of equals."""
    c = F.col
    similar = pairs.withColumn("_s", sequence_ratio(F.lower(rebuilt(c("author"), c("year"), c("title"))), F.lower("raw")))
    scored = similar.withColumn("_score", score(c("raw"), c("author"), c("year"), c("title"), c("_s")))
    best = F.max_by(F.struct("author", "year", "title", "doi", "_score"), F.struct("_score", -F.col("arrival"))).alias("b")
    found = scored.groupBy(*keys).agg(best)
    ok = (c("b._score") >= THRESHOLD) & (F.coalesce("b.doi", F.lit("")) != "")
    return found.select(*keys, "b.author", "b.year", "b.title", "b.doi", F.round("b._score", 2).alias("score"), ok.alias("ok"))


def marker(n: Column, ok: Column, author: Column, year: Column, title: Column) -> Column:
    """What a reference shows in a marker that is scanned by text."""
    shown_year = F.coalesce(year.cast("string"), F.lit("n.d."))
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat(author, F.lit(', "'), title, F.lit('", '), shown_year)).otherwise(F.concat(author, F.lit(", "), shown_year))
    return F.when(ok, named).otherwise(F.concat(F.lit("NEEDS REVIEW: ref "), n.cast("string")))


def _replaced(text: Column, pattern: str, spec, markers: Column) -> Column:
    def one(m):
        numbers = expand_plain(spec(m["match"]), F.map_keys(markers))
        shown = F.concat(F.lit("{"), F.array_join(F.transform(numbers, lambda n: F.element_at(markers, n)), "; "), F.lit("}"))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(F.size(numbers) > 0, shown).alias("text"))

    return apply_replacements(text, F.transform(matches(text, pattern), one))


def rewrite_text(text: Column, markers: Column) -> Column:
    """Bracketed and then superscript numbers replaced; ``markers`` maps a number to what it shows."""
    bracketed = _replaced(text, GROUP, lambda m: F.regexp_extract(m, GROUP, 1), markers)
    return _replaced(bracketed, f"[{SUPERSCRIPTS}]+", lambda m: F.translate(m, SUPERSCRIPTS + SEPARATORS, "0123456789-,"), markers)


def to_rtf(text: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    lines = F.replace(F.replace(escaped, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\\par\n"))
    return F.concat(F.lit("{\\rtf1\\ansi\\deff0\n"), lines, F.lit("\n}\n"))


def doi_list(matched: DataFrame, group: list[str], order: str) -> DataFrame:
    """``(group, dois)``: the accepted references' DOIs, one a line, in order; empty without any."""
    some = F.when(F.col("ok") & F.col("doi").isNotNull(), F.struct(order, "doi"))
    listed = F.transform(F.array_sort(F.collect_list(some)), lambda x: F.concat(x["doi"], F.lit("\n")))
    return matched.groupBy(*group).agg(F.array_join(listed, "").alias("dois"))
