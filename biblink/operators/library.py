"""Library items: built from candidates, matched to what is there, created in batches; and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..cuts import materialize
from ..functions.text import norm_doi, norm_text, title_case
from .match import present

BATCH = 50
# Item types as the citation format names them.
CSL_TYPES = {"journalArticle": "article-journal", "book": "book", "bookSection": "chapter"}
CREATOR = "array<struct<creatorType:string,firstName:string,lastName:string,name:string>>"


def _given(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def pages(first: Column, last: Column) -> Column:
    return F.when(_given(first).isNotNull() & _given(last).isNotNull(), F.concat(first, F.lit("-"), last)).otherwise(F.coalesce(_given(first), F.lit("")))


def creators(authors: Column, corporate: Column) -> Column:
    """A corporate author first, then surnames."""
    person = lambda s: F.struct(F.lit("author").alias("creatorType"), F.lit("").alias("firstName"), s.alias("lastName"), F.lit(None).cast("string").alias("name"))
    people = F.transform(F.filter(authors, present), person)
    body = F.array(F.struct(F.lit("author").alias("creatorType"), F.lit(None).cast("string").alias("firstName"), F.lit(None).cast("string").alias("lastName"), corporate.alias("name")))
    return F.when(present(corporate), F.concat(body, people)).otherwise(people).cast(CREATOR)


RAW_PEOPLE = """author array<struct<given:string,family:string,name:string>>, authorList struct<author:array<struct<collectiveName:string,lastName:string,firstName:string,initials:string>>>,
  authors array<struct<name:string,authtype:string>>"""


def creators_from_raw(raw: Column, authors: Column, corporate: Column) -> Column:
    """Full names where the provider's record (JSON) has them, by the fields of three indexes in
    turn; else surnames as in :func:`creators`."""
    w = F.from_json(raw, RAW_PEOPLE)
    none = F.lit(None).cast("string")
    made = lambda first, last, name: F.struct(F.lit("author").alias("creatorType"), first.alias("firstName"), last.alias("lastName"), name.alias("name"))
    person, body = (lambda first, last: made(F.coalesce(first, F.lit("")), last, none)), (lambda name: made(none, none, name))
    listed = lambda people, one: F.array_compact(F.transform(people, one))

    def pubmed(a):
        initials = F.regexp_extract(a["name"], r"^.* ([^ ]*)$", 1)
        short = (F.upper(initials) == initials) & (F.lower(initials) != initials) & (F.length(initials) <= 4)
        split = ~F.coalesce(a["authtype"] == "CollectiveName", F.lit(False)) & short
        return F.when(present(a["name"]), F.when(split, person(initials, F.regexp_extract(a["name"], r"^(.*) [^ ]*$", 1))).otherwise(body(a["name"])))

    found = [
        listed(w["author"], lambda a: F.when(present(a["family"]), person(a["given"], a["family"])).when(present(a["name"]), body(a["name"]))),
        listed(w["authorList"]["author"], lambda a: F.when(present(a["collectiveName"]), body(a["collectiveName"])).when(present(a["lastName"]), person(F.coalesce(_given(a["firstName"]), a["initials"]), a["lastName"]))),
        listed(w["authors"], pubmed),
    ]
    return F.coalesce(*[F.when(F.size(x) > 0, x.cast(CREATOR)) for x in found], creators(authors, corporate))


def enrich(chosen: DataFrame, canonical: DataFrame, fields: list[str]) -> DataFrame:
    """Chosen candidates with a DOI whose record names no authors, replaced by the canonical
    record of that DOI; a book stays one.  ``canonical(doi, fields)`` has a row for each DOI."""
    named = F.size(F.from_json("raw", RAW_PEOPLE)["author"]) > 0
    record = canonical.select(norm_doi(F.col("doi")).alias("_d"), F.struct(*fields).alias("_r"))
    joined = chosen.withColumn("_k", F.when(F.coalesce(~named, F.lit(True)), norm_doi(F.col("doi")))).join(record, F.col("_k") == F.col("_d"), "left")
    better = present(F.col("_r.title"))

    def field(name):
        if name == "providers":
            return F.when(better, F.array_sort(F.array_union("providers", F.array(F.lit("crossref:canonical"))))).otherwise(F.col("providers"))
        kept = F.col("item_type").isin("book", "bookSection") if name == "item_type" else F.lit(False)
        return F.when(better & ~kept, F.col(f"_r.{name}")).otherwise(F.col(name))

    return joined.select(*[field(f).alias(f) if f in fields else F.col(f) for f in chosen.columns])


def item_columns() -> dict[str, Column]:
    """Item fields of a row with ``r_`` reference and ``c_`` candidate fields; the reference fills gaps."""
    c = F.col
    either = lambda name: F.coalesce(_given(c(f"c_{name}")), _given(c(f"r_{name}")), F.lit(""))
    kind = F.coalesce(_given(c("c_item_type")), F.lit("journalArticle"))
    article, book = kind == "journalArticle", kind.isin("book", "bookSection")
    paged = pages(F.coalesce(_given(c("c_first_page")), c("r_first_page")), F.coalesce(_given(c("c_last_page")), c("r_last_page")))
    return {
        "itemType": kind,
        "title": either("title"),
        "creators": creators(c("c_authors"), c("c_corporate")),
        "date": F.coalesce(c("c_year").cast("string"), c("r_year").cast("string"), F.lit("")),
        "DOI": norm_doi(c("c_doi")),
        "extra": F.when(present(c("c_pmid")), F.concat(F.lit("PMID: "), c("c_pmid"))),
        "publicationTitle": F.when(article, either("journal")),
        "journalAbbreviation": F.when(article, F.coalesce(_given(c("c_journal_abbrev")), _given(c("r_journal")), F.lit(""))),
        "volume": F.when(article, either("volume")),
        "issue": F.when(article, either("issue")),
        "pages": F.when(article | (kind == "bookSection"), paged),
        "publisher": F.when(book, either("publisher")),
        "place": F.when(book, either("place")),
        "edition": F.when(book, _given(c("r_edition"))),
        "bookTitle": F.when(kind == "bookSection", either("book_title")),
    }


def library_matches(items: DataFrame, library: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, key)``: the library's item by DOI, else by title and year; null where there is none.
    Of library items with one identity the first key stays."""
    by_doi = library.where("doi is not null").groupBy(norm_doi(F.col("doi")).alias("d")).agg(F.min("key").alias("kd"))
    titled = F.concat(norm_text(F.col("title")), F.lit("|"), F.substring(F.coalesce("date", F.lit("")), 1, 4))
    by_title = library.where(norm_text(F.col("title")) != "").groupBy(titled.alias("t")).agg(F.min("key").alias("kt"))
    named = items.select(*keys, norm_doi(F.col("DOI")).alias("d"), titled.alias("t"))
    return named.join(by_doi, "d", "left").join(by_title, "t", "left").select(*keys, F.coalesce("kd", "kt").alias("key"))


def first_of_each(items: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """``(keys, first)``: of items with one identity, DOI or else title and year, the first by
    key stands for all; ``on`` tells within what, such as a manuscript.  Items without
    an identity stand for themselves."""
    titled = F.when(norm_text(F.col("title")) != "", F.concat(norm_text(F.col("title")), F.lit("|"), F.substring(F.coalesce("date", F.lit("")), 1, 4)))
    me = F.struct(*keys)
    same = F.coalesce(norm_doi(F.col("DOI")), titled, F.concat(F.lit("#"), me.cast("string")))
    named = items.select(*dict.fromkeys([*keys, *(on or [])]), same.alias("_same"))
    first = named.groupBy(*(on or []), "_same").agg(F.min(me).alias("first"))
    return named.join(first, [*(on or []), "_same"]).select(*keys, "first")


def creation_batches(pending: DataFrame, order: list[str], size: int = BATCH, group: list[str] | None = None) -> DataFrame:
    """Adds ``batch`` and a dry run's key, numbered over what is pending, within each manuscript
    or over everything.  Everything is sorted by ranges and numbered from each
    range's count: no task sees all rows."""
    if group:
        numbered = pending.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long"))
    else:
        placed = materialize(pending.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
        part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        # a row for each partition
        counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).select("_part", "_before")
        numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rn", F.col("_before") + inside + 1).drop("_part", "_before", "_at")
    return numbered.withColumns({"batch": F.floor((F.col("_rn") - 1) / size).cast("int"), "dry_key": F.format_string("DRYRUN%03d", F.col("_rn") - 1)}).drop("_rn")


def csl_json(key: Column) -> Column:
    """An item's record in the citation format, as compact JSON without empty fields."""
    c = F.col
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CSL_TYPES.items() for x in kv]), c("itemType")), F.lit("article-journal"))
    person = F.transform(
        F.filter("creators", lambda x: present(x["name"]) | present(x["lastName"])),
        lambda x: F.struct(_given(x["name"]).alias("literal"), F.when(~present(x["name"]), x["lastName"]).alias("family"), F.when(~present(x["name"]), _given(x["firstName"])).alias("given")),
    )
    issued = F.when(present(F.trim("date")), F.struct(F.array(F.array(F.trim("date"))).alias("date-parts")))
    return F.to_json(
        F.struct(
            key.alias("id"), kind.alias("type"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(_given(c("publicationTitle")), _given(c("bookTitle"))).alias("container-title"),
            _given(c("journalAbbreviation")).alias("journalAbbreviation"), _given(c("volume")).alias("volume"), _given(c("issue")).alias("issue"), _given(c("pages")).alias("page"),
            _given(c("DOI")).alias("DOI"), _given(c("edition")).alias("edition"), _given(c("publisher")).alias("publisher"), _given(c("place")).alias("publisher-place"),
            F.when(F.size(person) > 0, person).alias("author"), issued.alias("issued"),
        )
    )


def pending_review(resolved: DataFrame, only_review: bool = False) -> DataFrame:
    """What is asked at review: all that isn't accepted, or only what waits for it."""
    return resolved.where(F.col("status") == "REVIEW" if only_review else F.col("status") != "ACCEPTED")


def review_options(candidate: Column, alternatives: Column) -> Column:
    """The current pick and then others, five at most."""
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(candidate), alternatives))), 1, 5)


def apply_decisions(resolved: DataFrame, decisions: DataFrame, keys: list[str], skip_resets: bool = False) -> DataFrame:
    """Review decisions over resolutions: ``(keys, kind, payload)`` with kind ``skip``,
    ``drop``, ``from-text``, ``doi`` or ``pick`` (a place among the options).  A dropped
    reference has no candidate; a skipped one stays as it is, or with
    ``skip_resets`` goes back to review."""
    c = F.col
    picked = F.get(review_options(c("candidate"), c("alternatives")), F.col("payload").cast("int") - 1)
    joined = resolved.join(decisions, keys, "left")
    manual = c("kind").isin("doi", "pick") & ((c("kind") == "doi") | picked.isNotNull())
    none = (c("kind") == "drop") | ((c("kind") == "skip") & F.lit(skip_resets))
    status = F.when(c("kind") == "drop", "DROPPED").when(none, "REVIEW").when(c("kind") == "from-text", "FROM_TEXT").when(manual, "ACCEPTED").otherwise(c("status"))
    return joined.select(
        *keys, status.alias("status"),
        F.when(none, "none").when(c("kind") == "from-text", "book-from-text").when(manual, "manual").otherwise(c("tier")).alias("tier"),
        F.when(c("kind") == "from-text", 0.80).when(manual, 1.0).otherwise(c("confidence")).alias("confidence"),
        F.when(none | (c("kind") == "from-text"), None).when(c("kind") == "doi", c("payload")).when(manual, picked).otherwise(c("candidate")).alias("candidate"),
    )


def describe(prefix: str = "c_") -> Column:
    """A candidate as review shows it."""
    c = lambda name: F.col(prefix + name)
    or_unknown = lambda x, other="?": F.coalesce(_given(x), F.lit(other))
    names = F.array_join(F.transform(F.slice(c("authors"), 1, 3), title_case), ", ")
    ident = F.coalesce(_given(c("doi")), F.concat(F.lit("PMID:"), _given(c("pmid"))), F.lit("no identifier"))
    place = F.concat(F.lit("v"), or_unknown(c("volume")), F.lit("("), or_unknown(c("issue")), F.lit("):"), or_unknown(c("first_page")))
    return F.struct(
        or_unknown(c("title"), "(untitled)").alias("title"), F.coalesce(_given(c("corporate")), _given(names), F.lit("?")).alias("who"), F.coalesce(_given(c("journal")), _given(c("publisher")), F.lit("?")).alias("where"),
        or_unknown(c("year")).alias("year"), place.alias("locator"), ident.alias("ident"), c("item_type").alias("itemType"), F.array_sort(c("providers")).alias("providers"),
    )


def summary(resolved: DataFrame, group: list[str]) -> DataFrame:
    """A run's counts by status, the dropped and the unresolved numbers, and its exit code."""
    count = lambda s: F.sum((F.col("status") == s).cast("int")).cast("long")
    numbers = lambda *s: F.array_sort(F.collect_list(F.when(F.col("status").isin(*s), F.col("n"))))
    out = resolved.groupBy(*group).agg(count("ACCEPTED").alias("accepted"), count("FROM_TEXT").alias("from_text"), numbers("DROPPED").alias("dropped"), numbers("REVIEW").alias("unresolved"))
    return out.withColumn("exit_code", F.when(F.size("unresolved") > 0, 1).otherwise(0))


def report_rows(resolved: DataFrame, refs: DataFrame, records: DataFrame, keys: list[str], item_keys: DataFrame | None = None) -> DataFrame:
    """The report's columns, one row for each reference.

    Identifiers and title are those of the chosen record, ``records(candidate,
    doi, pmid, title)``; an item made of the reference's own text shows that
    text's.  ``item_keys(keys, key)`` are the library's keys of what was made.
    """
    c = F.col
    own = refs.select(*keys, "raw", F.col("title").alias("_t"), F.col("doi").alias("_d"), F.col("pmid").alias("_p"))
    chosen = records.select("candidate", F.col("title").alias("_ct"), F.col("doi").alias("_cd"), F.col("pmid").alias("_cp"))
    joined = resolved.join(own, keys).join(chosen, "candidate", "left")
    joined = joined.join(item_keys.select(*keys, F.col("key").alias("_key")), keys, "left") if item_keys is not None else joined.withColumn("_key", F.lit(None).cast("string"))
    shown = lambda record, text: F.coalesce(F.when(c("status") == "FROM_TEXT", c(text)).otherwise(c(record)), F.lit(""))
    return joined.select(
        *keys, "status", "tier", "confidence", shown("_cd", "_d").alias("doi"), shown("_cp", "_p").alias("pmid"), F.coalesce("_key", F.lit("")).alias("zotero_key"),
        shown("_ct", "_t").alias("resolved_title"), "reason", F.array_join("notes", " | ").alias("advisory"), c("raw").alias("raw_reference"),
    )


def write_report(report: DataFrame, order: list[str], path: str) -> None:
    """The report as CSV with a header, in order; files follow one another by name."""
    report.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
