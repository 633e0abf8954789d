"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidate spans are found in each whole text; their values are hashed, and each
hash is counted over distinct repositories and owners of the whole corpus.
Values that many owners or very many repositories have are copied examples;
others that look random are live-looking credentials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import matches, scan
from .common import column, cut, packed, unpacked

# The base patterns, kinds in their listed order.  The letter
# classes spell out either case so that only ASCII letters match.
_ANY_CASE = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
KEYWORDS = "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), _ANY_CASE("api") + "_?" + _ANY_CASE("key")])
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The method's own candidates: long unbroken runs of key-like characters.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
MIN_ASSIGN_VALUE = 6
#: A value that this many owners have is a copied example.
EXAMPLE_OWNERS = 3
#: So is one that more repositories than this have, whoever owns them.
EXAMPLE_REPOS = 100
#: A value with fewer distinct characters isn't live-looking.
MIN_DISTINCT = 10



def _matches(text: Column, pattern: str, kind: int, group: int) -> Column:
    """All leftmost matches of one kind, with the value that stands in a group."""
    span = lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.regexp_extract(m["match"], pattern, group).alias("value"))
    return F.transform(matches(text, pattern), span)


def candidate_spans(text: Column) -> tuple[Column, Column]:
    """The base spans of a text, and the method's further candidates."""
    assign = F.filter(_matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= MIN_ASSIGN_VALUE)
    base = F.concat(assign, _matches(text, ACCESS, 1, 0), _matches(text, HEX, 2, 0))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return base, F.filter(_matches(text, OPAQUE, 3, 0), lambda s: mixed(s["value"]))


def _distinct_characters(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def scanned(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str, *carried: Column) -> tuple[DataFrame, DataFrame]:
    """``(row, doc_id, base, more, carried)`` of each row and ``(row, spans)`` of those with spans:
    all of a row, each with the verdict on its value: ``n_repos``, ``n_owners``,
    ``example``, ``live``.  The texts are scanned once, and what is found is stored."""
    source = docs.select(
        *carried,
        column(id_col).alias("doc_id"),
        F.coalesce(column(text_col), F.lit("")).alias("scanned"),
        F.coalesce(column(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(column(owner_col).cast("string"), F.lit("")).alias("owner"),
    )
    base, more = candidate_spans(F.col("scanned"))
    hashed = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"].cast("binary"), 256).alias("h"), _distinct_characters(s["value"]).alias("distinct"))
    )
    rows = cut(
        source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", hashed(base).alias("base"), hashed(more).alias("more"), *[c for c in source.columns if c in ("cells", "text")]),
        "spans",
    )
    # a further candidate that overlaps a base span is that span's own value
    own = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    found = rows.select("row", "repo", "owner", F.explode(F.concat("base", own)).alias("s")).select("row", "repo", "owner", "s.*")
    # distinct owners and repositories of a value, each over rows that are already distinct
    pairs = found.select("h", "repo", "owner").distinct()
    owners = pairs.select("h", "owner").distinct().groupBy("h").agg(F.count("*").alias("n_owners"))
    repos = pairs.select("h", "repo").distinct().groupBy("h").agg(F.count("*").alias("n_repos"))
    frequency = cut(owners.join(repos, "h"), "frequency")
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") > EXAMPLE_REPOS)
    judged = found.join(frequency, "h").select(
        "row", F.struct("start", "kind", "end", "n_repos", "n_owners", example.alias("example"), (~example & (F.col("distinct") >= MIN_DISTINCT)).alias("live")).alias("s")
    )
    # of the further candidates only live-looking ones become spans
    kept = judged.where((F.col("s.kind") < 3) | F.col("s.live"))
    per_row = cut(kept.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans")), "judged")
    return rows, per_row


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, copies)``.

    One row for each input row.  Null texts count as empty, null repositories and
    owners as one unnamed each; repeated rows each count as occurrences but not
    as further owners; other columns are not read; an empty table gives no rows.  ``spans`` lists ``kind:start:end`` in code points,
    ``copies`` the ``n_repos:n_owners`` of each in the same order.
    """
    rows, per_row = scanned(docs, id_col, text_col, repo_col, owner_col)
    found = rows.join(per_row, "row", "left").select("doc_id", "base", "spans")
    count = lambda spans, test: F.size(F.filter(spans, test)).cast("long")
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    of_kind = lambda k: count(F.col("base"), lambda s: s["kind"] == k)
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        count(spans, lambda s: s["live"]).alias("n_live"),
        count(spans, lambda s: s["example"]).alias("n_example"),
        F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["n_repos"], s["n_owners"])), ",").alias("copies"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", live: str = "[SECRET]", example: str = "[EXAMPLE]") -> DataFrame:
    """The same rows and columns, whatever the names of the others; spans in the text are
    replaced by ``live``, or by ``example`` where the value is a widely copied one.

    Overlapping spans are replaced as one.  Null texts stay null; repeated rows
    are cleaned alike; an empty table gives no rows.  Only texts that hold a
    candidate are exchanged to meet their spans.
    """
    rows, spans = scanned(docs, id_col, text_col, repo_col, owner_col, packed(docs, (text_col,)).alias("cells"), column(text_col).alias("text"))
    text, has = F.col("text"), F.size("base") + F.size("more") > 0

    def step(at, s):
        # what overlaps the span before it is part of that one
        tag = F.when(s["start"] >= at, F.when(s["example"], example).otherwise(live))
        return F.greatest(at, s["end"]), F.struct(at.alias("from"), (s["start"] - at).alias("n"), tag.alias("tag"))

    pieces = scan(F.col("spans"), F.lit(0), step, "struct<from:int,n:int,tag:string>")
    changed = F.transform(F.filter(pieces, lambda p: p["tag"].isNotNull()), lambda p: F.concat(F.substr(text, p["from"] + 1, p["n"]), p["tag"]))
    rest = F.substr(text, F.array_max(F.transform("spans", lambda s: s["end"])) + 1)
    cleaned = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(changed, ""), rest)).otherwise(text)
    marked = rows.where(has).join(spans, "row", "left").select("cells", cleaned.alias("text"))
    return marked.unionByName(rows.where(~has).select("cells", "text")).select(*unpacked(docs, F.col("cells"), {text_col: F.col("text")}))
