"""References in free text to typed records, as projections.

The parser is a chain of ``withColumns`` steps over one row: identifiers are
taken out first, then the locator is read, then the rest is cut into segments
whose roles (authors, title, journal or imprint) follow from their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_reference, empty_to_null

# The shapes of identifiers, locators and imprints.
LEAD_NUMBER = r"^\s*[\[(]?\s*\d{1,3}\s*[.)\]]\s+"
DOI = r"(?i)\b10\.\d{4,9}/[^\s\"<>,;]+"
DOI_TAIL = r"[.,;:)\]}>'\"]+$"
PMID = r"(?i)\bPMID:?\s*(\d{4,9})\b"
PMCID = r"(?i)\b(PMC\d{4,9})\b"
YEAR = r"\b(?:19|20)\d{2}\b"
LOCATOR = (
    r"\b((?:19|20)\d{2})\s*;\s*([A-Za-z]?[\dA-Za-z]{0,8}?(?:-[A-Za-z]{1,2})?)"
    r"(?:\s*([Ss]uppl(?:ement)?\.?\s*[\dA-Za-z]{0,4}))?\s*(?:\(\s*([^)]{1,20})\s*\))?\s*"
    r":\s*([A-Za-z]{0,3}\d+)(?:\s*-\s*([A-Za-z]{0,3}\d+))?"
)
IMPRINT = (
    r"^([^:;]{2,40}):\s*([^;,]{2,60})[;,]\s*((?:19|20)\d{2})"
    r"(?:\s*:\s*([A-Za-z]?\d+)(?:\s*-\s*([A-Za-z]?\d+))?)?\.?$"
)
EDITION = r"(?i)^(\d+(?:st|nd|rd|th)|rev(?:ised)?|\d+)\s*edn?\.?$"
INLINE_EDITION = r"(?i),\s*(\d+(?:st|nd|rd|th)|rev(?:ised)?)\s*edn?\.?\s*$"
CHAPTER = r"(?i)^In:\s*.+?,?\s*eds?\.?$"
CORPORATE = (
    r"(?i)\b(?:collaborators?|collaboration|group|consortium|committee|initiative|investigators|network"
    r"|study team|working party|organization|organisation|who|unicef|world health)\b"
)
AUTHOR = r"(?U)^((?:[A-Z][\w'’-]*(?:\s+[a-z]{2,3})?(?:[-\s][A-Z][\w'’-]*)*))\s+((?:[A-Z]\.?){1,4})$"
INITIALS = r"^(?:[A-Z]\.?){1,4}$"
ET_AL = r"(?i),?\s*et al\.?$"
BARE_YEAR = r"^(?:19|20)\d{2}\.?$"
NOISE = r"(?i)\b(?:doi|available from|accessed)\b[:.]?\s*"

FIELDS = (
    "doi", "pmid", "pmcid", "authors", "corporate", "title", "journal", "year", "volume", "issue",
    "first_page", "last_page", "is_book", "is_chapter", "book_title", "publisher", "place", "edition",
)


def _group(s: Column, pattern: str, i: int) -> Column:
    """A group of the first match; null without a match or where the group is empty."""
    return empty_to_null(F.regexp_extract(s, pattern, i))


def _no_stop(s: Column) -> Column:
    return F.rtrim(s, F.lit("."))


def expand_page(first: Column, last: Column) -> Column:
    """A last page with the digits and letters that its abbreviation leaves out."""
    shape = r"^([A-Za-z]*)(\d+)$"
    letters_f, digits_f = F.regexp_extract(first, shape, 1), F.regexp_extract(first, shape, 2)
    letters_l, digits_l = F.regexp_extract(last, shape, 1), F.regexp_extract(last, shape, 2)
    head = F.substring(digits_f, F.lit(1), F.greatest(F.length(digits_f) - F.length(digits_l), F.lit(0)))
    whole = F.concat(F.coalesce(empty_to_null(letters_l), letters_f), head, digits_l)
    return F.when(first.rlike(shape) & last.rlike(shape), whole).otherwise(last)


def segments(s: Column) -> Column:
    """Sentence-like pieces: cut after a stop that white space follows."""
    return F.filter(F.transform(F.split(s, r"(?<=[.?!])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def _chunks(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda c: c != "")


def looks_like_authors(segment: Column) -> Column:
    """At least half of the comma-separated parts, rounded down, are a surname with initials."""
    parts = _chunks(F.regexp_replace(_no_stop(segment), ET_AL, ""))
    hits = F.size(F.filter(parts, lambda c: c.rlike(AUTHOR)))
    return (F.size(parts) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2)))


def authors_of(segment: Column) -> tuple[Column, Column]:
    """Surnames, and a corporate author where the segment names one instead."""
    plain = F.regexp_replace(_no_stop(F.trim(segment)), ET_AL, "")
    corporate = plain.rlike(CORPORATE) & ~looks_like_authors(plain)

    def surname(c):
        first = F.element_at(F.split(c, r"\s+"), 1)
        usable = first.rlike(r"^\p{Lu}") & (F.length(first) > 1) & ~first.rlike(INITIALS)
        return F.when(c.rlike(AUTHOR), F.regexp_extract(c, AUTHOR, 1)).when(usable, first)

    names = F.array_compact(F.transform(_chunks(plain), surname))
    nobody = F.array().cast("array<string>")
    return F.when(corporate, nobody).otherwise(names), F.when(corporate | ((F.size(names) == 0) & plain.rlike(CORPORATE)), plain)


def _first(array: Column, test) -> Column:
    """Position, from 1, of the first element that passes; 0 if none does."""
    return F.array_position(F.transform(array, test), True).cast("int")


def _last(array: Column, test) -> Column:
    back = _first(F.reverse(array), test)
    return F.when(back > 0, F.size(array) + 1 - back).otherwise(0)


def _between(array: Column, start: Column, stop: Column) -> Column:
    """Elements ``start`` to ``stop`` (both from 1, inclusive), joined by a space."""
    return F.array_join(F.slice(array, start, F.greatest(stop - start + 1, F.lit(0))), " ")


def parse_references(refs: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds the fields of a parsed reference to each row; columns of the same names are replaced."""
    carried = [F.col(c) for c in refs.columns if c not in FIELDS]
    c = F.col
    text = F.regexp_replace(clean_reference(c(raw_col)), LEAD_NUMBER, "")
    d = refs.select(*carried, text.alias("_t"))
    found_doi = _group(c("_t"), DOI, 0)
    d = d.withColumns({"doi": F.lower(F.regexp_replace(found_doi, DOI_TAIL, "")), "_t": F.when(found_doi.isNull(), c("_t")).otherwise(F.replace(c("_t"), found_doi, F.lit(" ")))})
    d = d.withColumns({"pmid": _group(c("_t"), PMID, 1), "_t": F.regexp_replace(c("_t"), PMID, " ")})
    d = d.withColumns({"pmcid": F.upper(_group(c("_t"), PMCID, 1)), "_t": F.regexp_replace(c("_t"), PMCID, " ")})
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c("_t"), r"\[[^\]]*\]", " "), NOISE, " "), r"https?://\S+", " ")
    d = d.withColumn("_t", F.trim(F.regexp_replace(bare, r"\s+", " ")))
    d = d.withColumns(
        {
            "_ly": _group(c("_t"), LOCATOR, 1).cast("int"),
            "volume": _group(c("_t"), LOCATOR, 2),
            "issue": empty_to_null(F.trim(F.regexp_extract(c("_t"), LOCATOR, 4))),
            "_lf": _group(c("_t"), LOCATOR, 5),
            "_ll": expand_page(_group(c("_t"), LOCATOR, 5), _group(c("_t"), LOCATOR, 6)),
            "_s": segments(c("_t")),
        }
    )
    d = d.withColumns({"_a": F.coalesce(F.get("_s", F.lit(0)), F.lit("")), "_b": F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1)))})
    names, corporate = authors_of(c("_a"))
    d = d.withColumns({"authors": names, "corporate": corporate, "_chapter": _first(c("_b"), lambda x: F.concat(_no_stop(x), F.lit(".")).rlike(CHAPTER))})

    # a chapter: its title comes before "In:", the book's right after, the imprint later
    rest = F.slice("_b", c("_chapter") + 1, F.size("_b"))
    d = d.withColumn("_r", F.when(c("_chapter") > 0, rest).otherwise(F.array().cast("array<string>")))
    book = _no_stop(F.coalesce(F.get("_r", F.lit(0)), F.lit("")))
    later = F.filter(F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1))), lambda x: x.rlike(IMPRINT))
    d = d.withColumns({"_ct": F.trim(book), "_ci": F.try_element_at(later, F.lit(1))})

    # otherwise an edition of its own leaves the body, and the tail is looked for
    d = d.withColumn("_e", F.when(c("_chapter") > 0, 0).otherwise(_first(c("_b"), lambda x: _no_stop(x).rlike(EDITION))))
    d = d.withColumns(
        {
            "_ed": F.when(c("_e") > 0, F.regexp_extract(_no_stop(F.get("_b", c("_e") - 1)), EDITION, 1)),
            "_b": F.filter("_b", lambda x, i: i != c("_e") - 1),
        }
    )
    d = d.withColumn("_tail", _first(c("_b"), lambda x: x.rlike(LOCATOR) | x.rlike(IMPRINT)))
    d = d.withColumn("_tail_seg", F.when(c("_tail") > 0, F.get("_b", c("_tail") - 1)))
    d = d.withColumns(
        {
            "_imprint": F.when((c("_tail") > 0) & ~c("_tail_seg").rlike(LOCATOR), c("_tail_seg")),
            "_bare": F.when(c("_tail") == 0, _last(c("_b"), lambda x: F.trim(x).rlike(BARE_YEAR))).otherwise(0),
        }
    )
    d = d.withColumns({"_i": F.when(c("_chapter") > 0, c("_ci")).otherwise(c("_imprint")), "_at": F.when(c("_tail") > 0, c("_tail")).otherwise(c("_bare"))})
    # text before the locator in its own segment is the journal
    before = F.btrim(F.split_part(F.regexp_replace(F.get("_b", c("_at") - 1), LOCATOR, "\u0001"), F.lit("\u0001"), F.lit(1)), F.lit(" ,.;"))
    before = F.when((c("_tail") > 0) & c("_tail_seg").rlike(LOCATOR) & (before != "") & ~before.rlike(r"^(?:19|20)\d{2}$"), before)
    d = d.withColumn("_before", before)
    chapter, on_book = c("_chapter") > 0, c("_imprint").isNotNull()
    title = (
        F.when(chapter, _between(c("_b"), F.lit(1), c("_chapter") - 1))
        .when(c("_at") == 0, F.array_join("_b", " "))
        .when(on_book | c("_before").isNotNull() | (c("_at") == 1), _between(c("_b"), F.lit(1), c("_at") - 1))
        .otherwise(_between(c("_b"), F.lit(1), c("_at") - 2))
    )
    journal = F.when(chapter | (c("_at") == 0) | on_book, "").when(c("_before").isNotNull(), c("_before")).when(c("_at") > 1, _no_stop(F.get("_b", c("_at") - 2))).otherwise("")
    years = F.regexp_extract_all(c("_t"), F.lit(f"({YEAR})"), F.lit(1))
    imprint_year = _group(c("_i"), IMPRINT, 3).cast("int")
    bare_year = F.when(c("_bare") > 0, _no_stop(F.trim(F.get("_b", c("_bare") - 1))).cast("int"))
    year = F.when(chapter, F.coalesce(imprint_year, c("_ly"))).otherwise(F.coalesce(c("_ly"), imprint_year, bare_year, F.try_element_at(years, F.lit(-1)).cast("int")))
    imprint_first = _group(c("_i"), IMPRINT, 4)
    imprint_last = expand_page(imprint_first, _group(c("_i"), IMPRINT, 5))
    tidy = lambda s: F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" .,;"))
    empty = F.size("_s") == 0
    d = d.withColumns(
        {
            "title": F.when(empty, "").otherwise(tidy(F.trim(_no_stop(title)))),
            "journal": F.when(empty, "").otherwise(tidy(journal)),
            "year": F.when(empty, c("_ly")).otherwise(year),
            "publisher": F.trim(_group(c("_i"), IMPRINT, 2)),
            "place": F.trim(_group(c("_i"), IMPRINT, 1)),
            "first_page": F.when(chapter & c("_i").isNotNull(), imprint_first).otherwise(F.coalesce(c("_lf"), imprint_first)),
            "last_page": F.when(chapter & c("_i").isNotNull(), imprint_last).otherwise(F.coalesce(c("_ll"), F.when(imprint_first.isNotNull(), imprint_last))),
            "edition": F.when(chapter, _group(c("_ct"), INLINE_EDITION, 1)).otherwise(c("_ed")),
            "book_title": F.when(chapter, F.trim(F.regexp_replace(c("_ct"), INLINE_EDITION, ""))).otherwise(""),
            "is_chapter": chapter,
        }
    )
    edition_only = c("publisher").isNull() & c("volume").isNull() & c("edition").isNotNull()
    d = d.withColumn("is_book", chapter | on_book | (~chapter & edition_only))
    return d.select(*carried, *FIELDS)


def complete_for_text_item(ref: str = "") -> Column:
    """Enough fields to build a library item from the reference's own text."""
    f = lambda name: F.col(f"{ref}{name}")
    has = lambda name: F.coalesce(f(name).cast("string") != "", F.lit(False))
    long_title = F.coalesce(F.length(f("title")) >= 8, F.lit(False))
    chapter = has("book_title") & has("year")
    whole_book = has("publisher") & has("year")
    article = has("journal") & has("year") & (has("volume") | has("first_page"))
    return long_title & F.when(f("is_chapter"), chapter).when(f("is_book"), whole_book).otherwise(article)
