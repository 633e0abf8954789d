"""Records of five bibliographic indexes, as JSON, to candidate rows.

Each adapter parses the fields it needs with an explicit schema; what is missing
or of another type is null.  ``raw`` keeps the record's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty_to_null, surname_of

MAX_AUTHORS = 60
# Item types as the indexes name them, and words of group authors.
CROSSREF_TYPES = {
    "journal-article": "journalArticle", "book": "book", "monograph": "book", "edited-book": "book", "reference-book": "book", "book-chapter": "bookSection",
    "book-section": "bookSection", "proceedings-article": "conferencePaper", "posted-content": "preprint", "report": "report", "dissertation": "thesis", "dataset": "dataset",
}
OPENALEX_TYPES = {
    "article": "journalArticle", "journal-article": "journalArticle", "book": "book", "book-chapter": "bookSection", "monograph": "book", "report": "report", "dissertation": "thesis",
    "preprint": "preprint", "proceedings-article": "conferencePaper", "paratext": "journalArticle", "editorial": "journalArticle", "letter": "journalArticle", "review": "journalArticle",
}
SEMANTIC_SCHOLAR_TYPES = {"Book": "book", "BookSection": "bookSection", "Conference": "conferencePaper"}
GROUP_AUTHOR = r"(?i)\b(?:collaborators?|group|consortium|committee|network)\b"

SCHEMAS = {
    "crossref": """title array<string>, DOI string, author array<struct<given:string,family:string,name:string>>, issued struct<`date-parts`:array<array<int>>>, page string, `container-title` array<string>,
      `short-container-title` array<string>, type string, volume string, issue string, publisher string, `publisher-location` string""",
    "europepmc": """title string, doi string, pmid string, pubYear string, pageInfo string, authorList struct<author:array<struct<lastName:string,collectiveName:string>>>, bookOrReportDetails string,
      journalInfo struct<volume:string,issue:string,journal:struct<title:string,medlineAbbreviation:string,isoabbreviation:string>>""",
    "openalex": """title string, display_name string, doi string, ids struct<pmid:string>, publication_year int, type string, biblio struct<volume:string,issue:string,first_page:string,last_page:string>,
      primary_location struct<source:struct<display_name:string,abbreviated_title:string,host_organization_name:string>>, authorships array<struct<raw_author_name:string,author:struct<display_name:string>>>""",
    "pubmed": """uid string, title string, authors array<struct<name:string,authtype:string>>, articleids array<struct<idtype:string,value:string>>, pubdate string, pages string, fulljournalname string, source string,
      volume string, issue string""",
    "semanticscholar": """title string, year int, venue string, externalIds struct<DOI:string,PubMed:string>, authors array<struct<name:string>>, publicationVenue struct<name:string,alternate_names:array<string>>,
      journal struct<name:string,volume:string,pages:string>, publicationTypes array<string>""",
}


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _typed(c: Column, types: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return F.coalesce(F.element_at(table, _blank(c)), F.lit("journalArticle"))


def _page_ends(pages: Column) -> tuple[Column, Column]:
    first = F.split_part(_blank(pages), F.lit("-"), F.lit(1))
    return empty_to_null(F.trim(first)), empty_to_null(F.trim(F.substr(_blank(pages), F.length(first) + 2)))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _named(people: Column, group, surname) -> tuple[Column, Column]:
    """Surnames of persons and the name of the first group among at most ``MAX_AUTHORS`` people."""
    people = F.slice(F.coalesce(people, F.array()), 1, MAX_AUTHORS)
    names = F.array_compact(F.transform(people, lambda a: F.when(group(a).isNull(), surname(a))))
    return names, _first(F.array_compact(F.transform(people, lambda a: group(a))))


def _by_words(name):
    """Groups told by words in their names."""
    return (lambda a: F.when(name(a).rlike(GROUP_AUTHOR), name(a))), (lambda a: F.when(_blank(name(a)) != "", surname_of(name(a))))


def _crossref(w) -> dict[str, Column]:
    given = lambda c: empty_to_null(c)
    authors, corporate = _named(w["author"], lambda a: F.when(given(a["family"]).isNull(), given(a["name"])), lambda a: F.when(given(a["family"]).isNotNull(), surname_of(F.trim(F.concat(_blank(a["given"]), F.lit(" "), a["family"])))))
    kind = _typed(w["type"], CROSSREF_TYPES)
    container = _blank(_first(w["container-title"]))
    first, last = _page_ends(w["page"])
    return dict(
        title=_blank(_first(w["title"])), doi=w["DOI"], authors=authors, corporate=corporate, year=_first(_first(w["issued"]["date-parts"])), journal=container, journal_abbrev=_blank(_first(w["short-container-title"])),
        volume=w["volume"], issue=w["issue"], first_page=first, last_page=last, item_type=kind, book_title=F.when(kind == "bookSection", container).otherwise(""), publisher=w["publisher"], place=w["publisher-location"],
    )


def _europepmc(w) -> dict[str, Column]:
    authors, corporate = _named(w["authorList"]["author"], lambda a: empty_to_null(a["collectiveName"]), lambda a: F.lower(empty_to_null(a["lastName"])))
    journal = w["journalInfo"]["journal"]
    first, last = _page_ends(w["pageInfo"])
    return dict(
        title=F.rtrim(_blank(w["title"]), F.lit(".")), doi=w["doi"], pmid=w["pmid"], authors=authors, corporate=corporate, year=F.when(w["pubYear"].rlike(r"^\d+$"), w["pubYear"].cast("int")), journal=_blank(journal["title"]),
        journal_abbrev=F.coalesce(empty_to_null(journal["medlineAbbreviation"]), journal["isoabbreviation"], F.lit("")), volume=empty_to_null(w["journalInfo"]["volume"]), issue=empty_to_null(w["journalInfo"]["issue"]),
        first_page=first, last_page=last, item_type=F.when(w["bookOrReportDetails"].isNotNull(), "book").otherwise("journalArticle"),
    )


def _openalex(w) -> dict[str, Column]:
    name = lambda a: F.coalesce(empty_to_null(a["author"]["display_name"]), a["raw_author_name"])
    authors, corporate = _named(w["authorships"], *_by_words(name))
    source, kind = w["primary_location"]["source"], F.lower(_blank(w["type"]))
    return dict(
        title=F.coalesce(empty_to_null(w["title"]), w["display_name"], F.lit("")), doi=w["doi"], pmid=F.element_at(F.split(F.rtrim(w["ids"]["pmid"], F.lit("/")), "/"), -1), authors=authors, corporate=corporate,
        year=w["publication_year"], journal=_blank(source["display_name"]), journal_abbrev=_blank(source["abbreviated_title"]), volume=w["biblio"]["volume"], issue=w["biblio"]["issue"],
        first_page=w["biblio"]["first_page"], last_page=w["biblio"]["last_page"], item_type=_typed(kind, OPENALEX_TYPES), publisher=F.when(kind.isin("book", "monograph", "book-chapter"), _blank(source["host_organization_name"])),
    )


def _pubmed(w) -> dict[str, Column]:
    by_words, surname = _by_words(lambda a: a["name"])
    authors, corporate = _named(w["authors"], lambda a: F.when(a["authtype"] == "CollectiveName", empty_to_null(a["name"])).otherwise(by_words(a)), surname)
    first, last = _page_ends(w["pages"])
    doi = _first(F.filter(w["articleids"], lambda i: i["idtype"] == "doi"))["value"]
    return dict(
        title=F.rtrim(_blank(w["title"]), F.lit(".")), doi=doi, pmid=empty_to_null(w["uid"]), authors=authors, corporate=corporate, year=empty_to_null(F.regexp_extract(_blank(w["pubdate"]), r"\b(?:19|20)\d{2}\b", 0)).cast("int"),
        journal=F.coalesce(empty_to_null(w["fulljournalname"]), w["source"], F.lit("")), journal_abbrev=_blank(w["source"]), volume=empty_to_null(w["volume"]), issue=empty_to_null(w["issue"]), first_page=first, last_page=last,
    )


def _semanticscholar(w) -> dict[str, Column]:
    authors, _ = _named(w["authors"], lambda a: F.lit(None).cast("string"), lambda a: F.when(_blank(a["name"]) != "", surname_of(a["name"])))
    known = F.filter(F.coalesce(w["publicationTypes"], F.array().cast("array<string>")), lambda t: t.isin(*SEMANTIC_SCHOLAR_TYPES))
    first, last = _page_ends(w["journal"]["pages"])
    return dict(
        title=_blank(w["title"]), doi=w["externalIds"]["DOI"], pmid=w["externalIds"]["PubMed"], authors=authors, year=w["year"], journal=F.coalesce(empty_to_null(w["journal"]["name"]), empty_to_null(w["publicationVenue"]["name"]), w["venue"], F.lit("")),
        journal_abbrev=_blank(_first(w["publicationVenue"]["alternate_names"])), volume=empty_to_null(F.trim(w["journal"]["volume"])), first_page=first, last_page=last, item_type=_typed(_first(known), SEMANTIC_SCHOLAR_TYPES),
    )


ADAPTERS = {"crossref": _crossref, "europepmc": _europepmc, "openalex": _openalex, "pubmed": _pubmed, "semanticscholar": _semanticscholar}
#: The fan-out's order; candidates of one paper keep it.
ARRIVAL = {name: i + 1 for i, name in enumerate(ADAPTERS)}

_DEFAULTS = {
    "title": "", "doi": None, "pmid": None, "corporate": None, "journal": "", "journal_abbrev": "", "volume": None, "issue": None, "first_page": None, "last_page": None, "item_type": "journalArticle",
    "book_title": "", "publisher": None, "place": None,
}


def candidates_from_json(records: DataFrame, provider: str, json_col: str = "json") -> DataFrame:
    """Candidate columns added to each record of one provider; broken JSON gives a candidate without fields."""
    parsed = records.withColumn("_w", F.coalesce(F.from_json(json_col, SCHEMAS[provider]), F.from_json(F.lit("{}"), SCHEMAS[provider])))
    fields = ADAPTERS[provider](F.col("_w"))
    fill = {k: F.lit(v).cast("string") for k, v in _DEFAULTS.items() if k not in fields}
    out = parsed.withColumns({**fields, **fill, "provider": F.lit(provider), "providers": F.array(F.lit(provider)), "arrival": F.lit(ARRIVAL[provider])})
    return out.drop("_w").withColumnRenamed(json_col, "raw")


def candidate_from_text() -> dict[str, Column]:
    """Candidate fields of a parsed reference's own text."""
    kind = F.when(F.col("is_chapter"), "bookSection").when(F.col("is_book"), "book").otherwise("journalArticle")
    same = ("title", "doi", "pmid", "authors", "corporate", "year", "journal", "volume", "issue", "first_page", "last_page", "book_title", "publisher", "place")
    return {**{f: F.col(f) for f in same}, "journal_abbrev": F.col("journal"), "item_type": kind, "provider": F.lit("reference-text"), "providers": F.array(F.lit("reference-text"))}


#: A candidate as the cache keeps it.
STORED = """provider string, title string, doi string, pmid string, authors array<string>, corporate string, year int, journal string, journal_abbrev string, volume string, issue string,
  first_page string, last_page string, item_type string, book_title string, publisher string, place string, providers array<string>, raw string"""
_STORED_FIELDS = [f.split()[0] for f in STORED.split(",")]


def candidate_to_json(c: str = "") -> Column:
    """A candidate's fields as JSON, nulls included, its providers sorted."""
    fields = [F.array_sort(c + f).alias(f) if f == "providers" else F.col(c + f).alias(f) for f in _STORED_FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def candidate_from_json(stored: Column) -> Column:
    """The candidate again, as a struct; without providers its own provider stands for them."""
    v = F.from_json(stored, STORED)
    theirs = F.when(F.size(v["providers"]) > 0, v["providers"]).otherwise(F.array(v["provider"]))
    return F.when(stored.isNotNull(), F.struct(*[(theirs if f == "providers" else v[f]).alias(f) for f in _STORED_FIELDS]))


def light_candidate(record: Column, provider: str) -> Column:
    """The few fields of a record that the predecessor compared: author, year, title, DOI."""
    w = F.from_json(record, SCHEMAS[provider])
    if provider == "crossref":
        lead = _first(w["author"])
        return F.struct(F.coalesce(empty_to_null(lead["family"]), lead["name"], F.lit("")).alias("author"), _first(_first(w["issued"]["date-parts"])).alias("year"), _blank(_first(w["title"])).alias("title"), w["DOI"].alias("doi"))
    year = empty_to_null(F.regexp_extract(_blank(w["pubdate"]), r"\b(?:19|20)\d{2}\b", 0)).cast("int")
    name = F.split_part(_blank(_first(w["authors"])["name"]), F.lit(" "), F.lit(1))
    return F.struct(name.alias("author"), year.alias("year"), _blank(w["title"]).alias("title"), _first(F.filter(w["articleids"], lambda i: i["idtype"] == "doi"))["value"].alias("doi"))
