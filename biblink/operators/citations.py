"""In-text citation markers: found, checked, expanded and rewritten, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import matches
from ..functions.text import fold_superscripts, title_case

SPAN = "array<struct<start:int,end:int,spec:string,bracketed:boolean>>"

# Notations, and words that take a number for themselves.
DIGITS, SEPARATORS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "⁻·"
GROUP = r"[\[(]\s*([\d\s,\-–—]+?)\s*[\])]"
SUPERSCRIPT_RUN = f"[{DIGITS}](?:[{DIGITS}{SEPARATORS}]*[{DIGITS}])?"
NUMBERS = r"\d{1,3}(?:\s*[-–—]\s*\d{1,3})?(?:\s*,\s*\d{1,3}(?:\s*[-–—]\s*\d{1,3})?)*"
ATTACHED = rf"(?<=[A-Za-z][.;,!?]){NUMBERS}"
DETACHED = rf"([A-Za-z]+)([.;,!?])?[  ]({NUMBERS})(.|$)"
BLOCKED = (
    "group groups grade grades table tables figure figures fig stage phase type level class no number chapter part "
    "section step arm visit score kl n p r version item question page line of to in at for from by with than up over under "
    "about approximately and or was were is are be been into onto per versus vs until till between within "
    "mean median total only all aged age range ratio the a an had has have each both every another"
).split()
TIMES = "month months week weeks day days year years hour hours visit visits session sessions cycle cycles".split()
UNITS = (
    "month months week weeks day days year years hour hours minute minutes time times fold patient patients case cases "
    "subject subjects participant participants study studies trial trials ml mm cm mg kg g l percent point points "
    "degree degrees unit units group groups session sessions injection injections site sites million billion thousand"
).split()
#: A range wider than this is a slip where it isn't bracketed.
MAX_RANGE = 8


def _char(text: Column, at: Column) -> Column:
    """The character at a position from 0; empty outside."""
    return F.when(at >= 0, F.substr(text, at + 1, F.lit(1))).otherwise("")


def _span(start, end, spec, bracketed: bool) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), spec.alias("spec"), F.lit(bracketed).alias("bracketed"))


def bracket_spans(text: Column) -> Column:
    return F.transform(matches(text, GROUP), lambda m: _span(m["start"], m["end"], F.regexp_extract(m["match"], GROUP, 1), True))


def is_mathematics(text: Column, start: Column, end: Column) -> Column:
    """A superscript that is an exponent or a variable's power."""
    before = _char(text, start - 1)
    lone = F.substr(text, F.lit(1), start).rlike(r"(?U)(?:^|[^\p{L}])\p{L}$")
    return before.rlike(rf"^[\d{SEPARATORS}×{DIGITS}]$") | (_char(text, end) == "=") | lone


def superscript_spans(text: Column) -> Column:
    kept = F.filter(matches(text, SUPERSCRIPT_RUN), lambda m: ~is_mathematics(text, m["start"], m["end"]))
    return F.transform(kept, lambda m: _span(m["start"], m["end"], fold_superscripts(m["match"]), False))


def attached_spans(text: Column) -> Column:
    return F.transform(matches(text, ATTACHED), lambda m: _span(m["start"], m["end"], m["match"], False))


def detached_spans(text: Column) -> Column:
    """Bare numbers after a space, where nothing shows that they belong to the prose."""

    def parts(m):
        group = lambda i: F.regexp_extract(m["match"], DETACHED, i)
        start = m["start"] + F.length(group(1)) + F.length(group(2)) + 1
        return F.struct(m["start"].alias("at"), group(1).alias("word"), group(2).alias("punct"), group(3).alias("nums"), group(4).alias("post"), start.alias("start"), (start + F.length(group(3))).alias("end"))

    def keep(p):
        low = F.lower(p["word"])
        values = F.transform(F.regexp_extract_all(p["nums"], F.lit(r"(\d+)"), F.lit(1)), lambda v: v.cast("int"))
        counted = F.substr(text, F.lit(1), p["at"]).rlike(r"\d\s*$")
        unit = F.lower(F.regexp_extract(F.substr(text, p["end"] + 1), r"^[\s)]*(?:and\s+\d{1,3}\s+)?([A-Za-z]+)", 1))
        prose = (
            low.isin(*BLOCKED)
            | (low.isin(*TIMES) & ~counted)
            | p["post"].rlike(r"^[\d%/×−\-–—]$")
            | p["nums"].rlike(r"^\d{1,3},\d{3}$")
            | unit.isin(*UNITS)
            | F.exists(values, lambda v: v == 0)
            | (values != F.array_sort(F.array_distinct(values)))
            | ((p["post"] == ".") & _char(text, p["end"] + 1).rlike(r"^\d$"))
        )
        ends = p["post"].isin("", ".", ",", ";", ":", "!", "?")
        return ~prose & (p["punct"].isin(".", "!", "?") | ends | (F.size(values) > 1))

    return F.transform(F.filter(F.transform(matches(text, DETACHED), parts), keep), lambda p: _span(p["start"], p["end"], p["nums"], False))


def resolve_overlaps(spans: Column) -> Column:
    """The earliest, of those the longest; what overlaps it or has no digit goes."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["spec"].alias("spec"), s["bracketed"].alias("bracketed"))))
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast(SPAN).alias("out"))

    def step(a, s):
        taken = (s["start"] >= a["last"]) & s["spec"].rlike(r"\d")
        span = F.array(F.struct(s["start"].alias("start"), (-s["neg"]).alias("end"), s["spec"].alias("spec"), s["bracketed"].alias("bracketed")))
        return F.when(taken, F.struct((-s["neg"]).alias("last"), F.concat(a["out"], span).alias("out"))).otherwise(a)

    return F.aggregate(keyed, zero, step, lambda a: a["out"])


def run_spans(runs: Column, text: Column) -> Column:
    """Contiguous runs that carry superscript formatting, merged across run boundaries."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("from"), F.array().cast(SPAN).alias("out"))
    piece = lambda a, b: F.array(_span(a, b, F.substr(text, a + 1, b - a), False))

    def step(a, r):
        raised = r["superscript"] & (F.trim(r["text"]) != "")
        out = F.when(~raised & (a["from"] >= 0), F.concat(a["out"], piece(a["from"], a["at"]))).otherwise(a["out"])
        begun = F.when(raised, F.when(a["from"] >= 0, a["from"]).otherwise(a["at"])).otherwise(-1)
        return F.struct((a["at"] + F.length(r["text"])).alias("at"), begun.alias("from"), out.alias("out"))

    return F.aggregate(runs, zero, step, lambda a: F.when(a["from"] >= 0, F.concat(a["out"], piece(a["from"], a["at"]))).otherwise(a["out"]))


def citation_spans(text: Column, runs: Column | None = None) -> Column:
    """Every citation marker of a paragraph, without overlaps; none in a null text."""
    text = F.coalesce(text, F.lit(""))
    kinds = [bracket_spans(text), superscript_spans(text), attached_spans(text), detached_spans(text)]
    if runs is not None:
        kinds.append(run_spans(runs, text))
    return resolve_overlaps(F.concat(*kinds))


def expand(spec: Column, bracketed: Column, known: Column) -> Column:
    """Reference numbers of a specification, those that are known, in order.  The whole
    specification is refused for a range from 0, one with neither end known, or a
    wide one that isn't bracketed."""
    chunks = F.transform(F.split(F.translate(spec, "–—", "--"), ","), lambda x: F.trim(x))
    whole = lambda s: F.trim(s).rlike(r"^\d+$")

    def ends(c):
        a = F.split_part(c, F.lit("-"), F.lit(1))
        b = F.substr(c, F.length(a) + 2)
        ok = F.contains(c, F.lit("-")) & whole(a) & whole(b)
        number = lambda s: F.when(whole(s), F.trim(s).cast("int"))
        return F.struct(ok.alias("range"), F.when(ok, number(a)).alias("lo"), F.when(ok, number(b)).alias("hi"), F.when(~F.contains(c, F.lit("-")), number(c)).alias("one"))

    parts = F.transform(chunks, ends)
    refused = F.exists(parts, lambda p: F.coalesce(p["range"] & ((p["lo"] == 0) | (~F.array_contains(known, p["lo"]) & ~F.array_contains(known, p["hi"])) | ((p["hi"] - p["lo"] > MAX_RANGE) & ~bracketed)), F.lit(False)))
    nobody = F.array().cast("array<int>")
    listed = F.flatten(F.transform(parts, lambda p: F.when(p["range"] & (p["hi"] >= p["lo"]), F.sequence(p["lo"], F.greatest(p["lo"], p["hi"]))).when(p["one"].isNotNull(), F.array(p["one"])).otherwise(nobody)))
    return F.when(refused, nobody).otherwise(F.filter(listed, lambda n: F.array_contains(known, n)))


def expand_plain(spec: Column, known: Column) -> Column:
    """Known numbers of a specification without its checks: each range is taken as written."""
    chunks = F.transform(F.split(F.translate(spec, "–—", "--"), ","), lambda x: F.trim(x))
    number = lambda s: F.when(s.rlike(r"^\d+$"), s.cast("int"))

    def listed(c):
        low, high = number(F.split_part(c, F.lit("-"), F.lit(1))), number(F.substr(c, F.length(F.split_part(c, F.lit("-"), F.lit(1))) + 2))
        several = F.filter(known, lambda k: (k >= low) & (k <= high))
        return F.when(F.contains(c, F.lit("-")), F.when(low.isNotNull() & high.isNotNull(), F.array_sort(several))).when(number(c).isNotNull(), F.filter(F.array(number(c)), lambda n: F.array_contains(known, n)))

    return F.flatten(F.filter(F.transform(chunks, listed), lambda x: x.isNotNull()))


def range_warnings(spec: Column, bracketed: Column, known: Column) -> Column:
    """What is odd about a specification's wide ranges, in order, up to where it is refused."""
    chunks = F.transform(F.split(F.translate(spec, "–—", "--"), ","), lambda x: F.trim(x))
    zero = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("out"))

    def step(a, c):
        first = F.split_part(c, F.lit("-"), F.lit(1))
        ends = [F.trim(x) for x in (first, F.substr(c, F.length(first) + 2))]
        ok = F.contains(c, F.lit("-")) & ends[0].rlike(r"^\d+$") & ends[1].rlike(r"^\d+$")
        low, high = (F.when(ok, e.cast("int")) for e in ends)
        prose = (low == 0) | (~F.array_contains(known, low) & ~F.array_contains(known, high))
        wide = ok & ~prose & (high - low > MAX_RANGE)
        shown, count = F.concat(F.lit("range '"), low.cast("string"), F.lit("-"), high.cast("string")), (high - low + 1).cast("string")
        taken = F.concat(shown, F.lit("' expands to "), count, F.lit(" references — bracketed, so taken as written; check it is not a typo"))
        left = F.concat(shown, F.lit("' spans "), count, F.lit(" references — likely a dropped digit in the manuscript; left unchanged"))
        said = F.when(F.coalesce(wide, F.lit(False)), F.array(F.when(bracketed, taken).otherwise(left))).otherwise(F.array().cast("array<string>"))
        return F.when(a["over"], a).otherwise(F.struct(F.coalesce(ok & (prose | (wide & ~bracketed)), F.lit(False)).alias("over"), F.concat(a["out"], said).alias("out")))

    return F.aggregate(chunks, zero, step, lambda a: a["out"])


def distinct_warnings(said: DataFrame, group: list[str], order: list[str], warnings: str = "warnings") -> DataFrame:
    """``(group, warnings)``: a document's warnings, each once, by first occurrence."""
    gathered = said.where(F.size(warnings) > 0).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, warnings))).alias("_w"))
    return gathered.select(*group, F.array_distinct(F.flatten(F.transform("_w", lambda w: w[warnings]))).alias("warnings"))


def deletion_span(text: Column, start: Column, end: Column) -> Column:
    """A span that is deleted takes the space before it along where none is needed."""
    after = _char(text, end)
    spaced = (start > 0) & (_char(text, start - 1) == " ") & (after.isin("", " ") | after.rlike(r"^[.,;:!?)\]]$"))
    return F.struct(F.when(spaced, start - 1).otherwise(start).alias("start"), end.alias("end"))


def label(n: Column, has_candidate: Column, ref_corporate: Column, cand_corporate: Column, ref_authors: Column, cand_authors: Column, year: Column) -> Column:
    given = lambda c: F.nullif(c, F.lit(""))
    who = F.coalesce(given(ref_corporate), given(cand_corporate), F.get(ref_authors, F.lit(0)), title_case(F.get(cand_authors, F.lit(0))), F.lit("Anon"))
    return F.when(has_candidate, F.concat(who, F.lit(", ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))).otherwise(F.concat(F.lit("ref "), n.cast("string")))


def render_one(n: Column, status: Column, key: Column, shown: Column, style: str = "scannable", uid: str = "0") -> Column:
    """One reference's marker: null for one that was dropped."""
    marked = F.concat(F.lit("{ | "), shown, F.lit(f" | | |zu:{uid}:"), key, F.lit("}")) if style == "scannable" else F.concat(F.lit("{"), shown, F.lit("}"))
    ready = status.isin("ACCEPTED", "FROM_TEXT") & key.isNotNull() & (key != "")
    return F.when(status == "DROPPED", None).when(ready, marked).otherwise(F.concat(F.lit("{NEEDS REVIEW: ref "), n.cast("string"), F.lit("}")))


def render(numbers: Column, markers: Column) -> Column:
    """Replacement for a span: null leaves it, an empty text deletes it.  ``markers`` maps
    a reference number to its marker, null for a dropped one."""
    parts = F.transform(numbers, lambda n: F.coalesce(F.element_at(markers, n), F.lit("")))
    return F.when(F.size(numbers) > 0, F.array_join(parts, ""))


def apply_replacements(text: Column, replacements: Column) -> Column:
    """``array<struct<start,end,text>>``, apart and in order, put into a text; null texts are left out."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, r):
        keep = F.substr(text, a["at"] + 1, r["start"] - a["at"])
        return F.struct(r["end"].alias("at"), F.concat(a["out"], keep, r["text"]).alias("out"))

    return F.aggregate(F.filter(replacements, lambda r: r["text"].isNotNull()), zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def rewrite(text: Column, spans: Column, known: Column, markers: Column) -> Column:
    """The text with its citation markers replaced, and deleted ones taken out with their space."""

    def one(s):
        new = render(expand(s["spec"], s["bracketed"], known), markers)
        gone = deletion_span(text, s["start"], s["end"])
        return F.struct(F.when(new == "", gone["start"]).otherwise(s["start"]).alias("start"), s["end"].alias("end"), new.alias("text"))

    return apply_replacements(text, F.transform(spans, one))
