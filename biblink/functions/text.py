"""Scalar normalisers as Column expressions; all stay in the JVM.

Unicode decomposition has no built-in.  Characters that decompose to one
character or none go through one ``translate``; the few that decompose to
several are mapped one by one, and only in texts that have them.  Both tables
are made by rule from the Unicode database when first needed.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the matching rules.
TITLE_STOPWORDS = ("the", "a", "an")
JOURNAL_STOPWORDS = ("the", "of", "and", "for", "in", "on", "a", "an", "de", "der", "la", "le")
CONSORTIUM_TAILS = ("collaborators", "collaborator", "collaboration", "group", "consortium", "committee", "investigators", "network")

#: Unicode spaces that count as a plain space in pasted manuscripts.
ODD_SPACES = " " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "  　"
DASHES = "‐‑‒–—―−"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁻·"


@cache
def _folding(form: str, keep_marks: bool) -> tuple[str, str, str, dict[str, str]]:
    """``translate``'s two strings, a class of characters that become several, and their map."""
    single, gone, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        d = unicodedata.normalize(form, c)
        if not keep_marks:
            d = "".join(x for x in d if not unicodedata.combining(x))
        if d == c:
            continue
        if not d:
            gone.append(c)
        elif len(d) == 1:
            single.append((c, d))
        elif not 0xAC00 <= code < 0xD7A4:  # Hangul syllables follow a rule of their own and fold to no letter here
            several[c] = d
    return "".join(c for c, _ in single) + "".join(gone), "".join(d for _, d in single), "".join(several), several


def _literal_map(table: dict[str, str]) -> Column:
    """One look-up table for all expressions that share it."""
    if len(table) < 200:
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.str_to_map(F.lit("\x02".join(f"{k}\x03{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x03"))


def _fold(s: Column, form: str, keep_marks: bool) -> Column:
    source, target, many, table = _folding(form, keep_marks)
    pairs = _literal_map(table)
    folded = F.translate(s, source, target)
    spelled = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.element_at(pairs, c), c)), "")
    return F.when(F.length(F.translate(folded, many, "")) < F.length(folded), spelled).otherwise(folded)


@cache
def _composing() -> tuple[dict[str, str], dict[str, str]]:
    """Pairs of a character and a mark with the character they make, and marks' classes."""
    pairs, classes = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and "<" not in parts[0]:
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", pair) == c:
                pairs[pair] = c
        if unicodedata.combining(c):
            classes[c] = str(unicodedata.combining(c))
    return pairs, classes


def _composed(cluster: Column) -> Column:
    """A decomposed character with the marks after it, the marks in canonical order, and
    composed with those that no mark of their class stands before."""
    pairs, classes = map(_literal_map, _composing())
    marks = F.transform(F.split(F.substr(cluster, F.lit(2)), ""), lambda c, i: F.struct(F.coalesce(F.element_at(classes, c).cast("int"), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")))
    # marks of class 0 part the others
    runs = F.transform(marks, lambda m: F.struct(F.size(F.filter(marks, lambda x: (x["k"] == 0) & (x["i"] <= m["i"]))).alias("run"), m["k"].alias("k"), m["i"].alias("i"), m["c"].alias("c")))
    ordered = F.array_sort(F.when(F.exists(marks, lambda m: m["k"] == 0), runs).otherwise(F.transform(marks, lambda m: F.struct(F.lit(0).alias("run"), m["k"].alias("k"), m["i"].alias("i"), m["c"].alias("c")))))
    state = lambda done, base, rest, last: F.struct(done.alias("done"), base.alias("base"), rest.alias("rest"), last.alias("last"))

    def step(at, m):
        made = F.element_at(pairs, F.concat(at["base"], m["c"]))
        free = (at["rest"] == "") | (at["last"] < m["k"])
        return (
            F.when(free & made.isNotNull(), state(at["done"], made, at["rest"], at["last"]))
            .when(m["k"] == 0, state(F.concat(at["done"], at["base"], at["rest"]), m["c"], F.lit(""), F.lit(0)))
            .otherwise(state(at["done"], at["base"], F.concat(at["rest"], m["c"]), m["k"]))
        )

    first = state(F.lit(""), F.substring(cluster, 1, 1), F.lit(""), F.lit(0))
    return F.when(F.length(cluster) == 1, cluster).otherwise(F.aggregate(ordered, first, step, lambda at: F.concat(at["done"], at["base"], at["rest"])))


def plain_ascii(s: Column) -> Column:
    return ~s.rlike(r"[^\x00-\x7F]")


def strip_accents(s: Column) -> Column:
    """Canonical decomposition without its combining marks."""
    return F.when(plain_ascii(s), s).otherwise(_fold(s, "NFD", False))


def nfkc(s: Column) -> Column:
    """Compatibility characters replaced, and separately typed marks composed with their letter.
    Separately typed Hangul letters stay apart."""
    clusters = F.regexp_extract_all(_fold(s, "NFKD", True), F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    return F.when(plain_ascii(s), s).when(s.rlike(r"\p{M}"), F.array_join(F.transform(clusters, _composed), "")).otherwise(_fold(s, "NFKC", True))


def _compatible_letters(s: Column) -> Column:
    return F.when(plain_ascii(s), s).otherwise(_fold(s, "NFKD", False))


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def tokens(s: Column) -> Column:
    """Space-separated tokens; none in a blank text."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def norm_text(s: Column) -> Column:
    """Letters and digits of a text in lower case, without tags, entities and articles; null is empty."""
    s = F.lower(_compatible_letters(F.coalesce(s, F.lit(""))))
    s = F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", " "), r"&(amp|lt|gt|quot|apos);", " ")
    s = F.regexp_replace(s, r"[^a-z0-9]+", " ")
    return F.array_join(F.filter(tokens(s), lambda t: ~t.isin(*TITLE_STOPWORDS)), " ")


def empty_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def norm_doi(s: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(s)), r"^https?://(dx\.)?doi\.org/", "")
    return empty_to_null(F.rtrim(F.regexp_replace(s, r"^doi:\s*", ""), F.lit(".")))


def clean_doi(s: Column) -> Column:
    """A DOI typed by hand: null unless it is one."""
    s = F.regexp_replace(F.trim(s), r"(?i)^https?://(dx\.)?doi\.org/", "")
    s = F.lower(F.regexp_replace(F.regexp_replace(s, r"(?i)^doi:\s*", ""), r"[.,;]+$", ""))
    return F.when(s.rlike(r"^10\.\d{4,9}/\S+$"), s)


def norm_surname(s: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(strip_accents(F.coalesce(s, F.lit("")))), r"[^a-z\s-]", ""))


def surname_of(name: Column) -> Column:
    """Surname of a displayed name: before a comma, else the last word and the
    lower-case particles right before it."""
    name = F.trim(F.coalesce(name, F.lit("")))
    last_words = F.regexp_extract(name, r"(?U)((?:(?<!\S)\p{Ll}\S*\s+)*\S+)$", 1)
    return norm_surname(F.when(F.contains(name, F.lit(",")), F.split_part(name, F.lit(","), F.lit(1))).otherwise(last_words))


def journal_tokens(s: Column) -> Column:
    s = F.regexp_replace(F.lower(strip_accents(F.coalesce(s, F.lit("")))), r"[^a-z0-9]+", " ")
    return F.filter(tokens(s), lambda t: ~t.isin(*JOURNAL_STOPWORDS))


def locator_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(s)), r"[^a-z0-9]", "")


def consortium_key(s: Column) -> Column:
    """A consortium's name without its general tail words, wherever they stand."""
    s = norm_text(s)
    for tail in CONSORTIUM_TAILS:
        s = F.replace(s, F.lit(tail), F.lit(" "))
    return squeeze(s)


def ref_key(raw: Column) -> Column:
    return F.sha1(norm_text(raw).cast("binary"))


def fold_superscripts(s: Column) -> Column:
    return F.translate(s, SUPERSCRIPTS, "0123456789-,")


def fold_spaces(s: Column) -> Column:
    return F.translate(s, ODD_SPACES, " " * len(ODD_SPACES))


def fixed2(x: Column) -> Column:
    """Two decimals of a double, rounded on its exact binary value, without grouping."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


def search_phrase(s: Column) -> Column:
    """Without punctuation and bare boolean operators."""
    s = F.regexp_replace(s, r"(?U)[^\w\s-]", " ")
    return squeeze(F.regexp_replace(s, r"\b(?:AND|OR|NOT)\b", " "))


def filter_value(s: Column) -> Column:
    """Without characters that a filter expression gives a meaning."""
    return squeeze(F.regexp_replace(s, r"[,|:+()\[\]{}]", " "))


def title_case(s: Column) -> Column:
    """Upper case for each letter that doesn't follow a letter, lower case for the others."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def clean_reference(s: Column) -> Column:
    """A pasted reference with one kind of dash, quote and space."""
    s = F.translate(nfkc(s), DASHES + "‘’“”", "-" * len(DASHES) + "''\"\"")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
