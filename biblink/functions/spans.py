"""Running folds over arrays, and matches of a pattern with their positions, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string>"
#: Elements that are folded at once.  Arrays are copied as they grow, so a long list
#: is built of blocks: work grows with the elements, not with their square.
BLOCK = 256


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """For each element in order what ``step(state, element)`` makes of it; ``step`` returns the
    next state and an element of type ``kind``.  Null for a null array."""
    nothing = F.array().cast(f"array<{kind}>")
    last = F.greatest(F.size(items) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))

    def one(a, item):
        state, out = step(a["state"], item)
        return F.struct(state.alias("state"), F.concat(a["out"], F.array(out.cast(kind))).alias("out"))

    def block(done, some):
        begin = F.struct(F.element_at(done, -1)["state"].alias("state"), nothing.alias("out"))
        return F.concat(done, F.array(F.aggregate(some, begin, one)))

    begin = F.array(F.struct(zero.alias("state"), nothing.alias("out")))
    return F.aggregate(blocks, begin, block, lambda done: F.flatten(F.transform(done, lambda b: b["out"])))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches as ``array<struct<start,end,match>>``, in code points: the stretches
    between matches and the matches add up to their positions.  None in a null text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(found, F.split(text, pattern, -1), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap"))), lambda p: p["m"].isNotNull())

    def place(at, p):
        start = at + p["gap"]
        end = start + F.length(p["m"])
        return end, F.struct(start.alias("start"), end.alias("end"), p["m"].alias("match"))

    return F.when(text.rlike(pattern), scan(pairs, F.lit(0), place, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))
