"""SimHash near-duplicate groups over a byte-position inverted index.

A fingerprint has eight positional bytes.  Two fingerprints at 3 or fewer
differing bits differ in at most three bytes, so they share at least five
positional bytes.  The index has a list for each choice of four positions and
each value of their bytes (the intersection of four single-byte lists: 32 fixed
bits, so that chance meetings stay rare at any size).  A pair that shares ``m``
positional bytes meets in ``C(m, 4)`` lists.  Meetings are tallied for each
pair; pairs under the guaranteed minimum of ``C(5, 4) = 5`` are dropped, and the
rest are verified by their differing bits.

No list of more than ``LONG_LIST`` fingerprints is paired.  A retained pair
shares a fifth byte, so a longer list is cut by each further position and value,
and a pair is tallied in the first of these shorter lists that it shares.  What
is still too long has 40 fixed bits and so at most 2**24 fingerprints; its
members are linked by sorting them with three of the free bits masked, for every
choice of three, until they hang together or all choices are through.  Rows grow
with the fingerprints, not with pairs, and no link is lost: a pair within the
limit is either tallied in full or lies in such a list.
"""

from __future__ import annotations

from itertools import chain, combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER_ASCII, as_bytes, column, cut, packed, row_key, small_batches, unpacked
from .components import connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
MIN_SHARED_BYTES = 8 - MAX_BITS
LIST_BYTES = MIN_SHARED_BYTES - 1
LISTS = list(combinations(range(8), LIST_BYTES))
#: Lists in which a pair with the fewest shared bytes meets.
MIN_MEETINGS = comb(MIN_SHARED_BYTES, LIST_BYTES)
#: Most fingerprints of a list that are paired.
LONG_LIST = 64
_CHUNK = 1 << 14
_BLOCK_BYTES = 1 << 20


def _blocks(text: bytes):
    """Lower-cased words of a text, a bounded number of bytes at a time, cut between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _BLOCK_BYTES)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].translate(LOWER_ASCII).split()
        at = end


def shingle_hashes(text: bytes | None, n: int = SHINGLE_WORDS):
    """XXH64 of every word n-gram of a text, repeats included, as arrays of unsigned 64-bit
    integers; a shorter text is one n-gram, one without words has none."""
    before: list[bytes] = []
    some = False
    for words in _blocks(text or b""):
        words = before + words
        if len(words) >= n:
            some = True
            grams = zip(*(words[i:] for i in range(n)))
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64, len(words) - n + 1)
        before = words[1 - n :]
    if before and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingle hashes; no words: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        n += len(hashes)
        for at in range(0, len(hashes), _CHUNK):
            part = hashes[at : at + _CHUNK]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint's bits as a signed long."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, fp long")


def _byte(col, position):
    """The byte at a position, given as a number or as a column."""
    shift = F.lit(8 * position) if isinstance(position, int) else position * 8
    return F.call_function("shiftrightunsigned", col, shift).bitwiseAND(F.lit(255))


def _listed(values, number):
    """The value at ``number``, a column of positions from 0."""
    return F.element_at(F.array(*map(F.lit, values)), number + 1)


def _entries(fps: DataFrame) -> DataFrame:
    """``(list, fp)``: the lists that each fingerprint is in, the choice of positions above its four bytes."""
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(LISTS) - 1))).alias("choice"))
    key = F.col("choice").cast("long")
    for place in range(LIST_BYTES):
        key = F.shiftleft(key, 8).bitwiseOR(_byte(F.col("fp"), _listed([positions[place] for positions in LISTS], F.col("choice"))))
    return each.select(key.alias("list"), "fp")


def _with_sizes(entries: DataFrame, by: list[str], name: str) -> DataFrame:
    """Entries of lists with two members or more, with their number ``n``: one exchange,
    whose sort spills where it must."""
    counted = entries.withColumn("n", F.count("*").over(W.partitionBy(*by)))
    return cut(counted.where("n > 1"), name)


def _meetings(members: DataFrame, by: list[str]) -> DataFrame:
    left, right = members.select(*by, F.col("fp").alias("a")), members.select(*by, F.col("fp").alias("b"))
    return left.join(right, by).where("a < b")


def fingerprint_links(fps: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """``fps(fp long)``, distinct, to ``(a, b)``: links that connect every two
    fingerprints at ``MAX_BITS`` or fewer differing bits."""
    # few bytes, of which much more is made: dealt to all tasks first
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    members = _with_sizes(_entries(spread), ["list"], "lists")
    met = _meetings(members.where(F.col("n") <= long_list), ["list"]).select("a", "b")

    # a longer list by each position that it doesn't fix, and the byte there
    choice = F.shiftright("list", 32).cast("int")
    free = _listed([[p for p in range(8) if p not in positions] for positions in LISTS], choice)
    long_ones = members.where(F.col("n") > long_list).select("list", "fp", F.explode(free).alias("p"))
    finer = _with_sizes(long_ones.select("list", "fp", "p", _byte(F.col("fp"), F.col("p")).alias("byte")), ["list", "p", "byte"], "finer")
    again = _meetings(finer.where(F.col("n") <= long_list), ["list", "p", "byte"])
    diff = F.col("a").bitwiseXOR(F.col("b"))
    once = ~F.exists(free, lambda p: (p < F.col("p")) & (_byte(diff, p) == 0))
    met = met.unionByName(again.where(once).select("a", "b"))

    tallied = met.groupBy("a", "b").agg(F.count("*").alias("meetings")).where(F.col("meetings") >= MIN_MEETINGS)
    links = tallied.where(F.bit_count(diff) <= MAX_BITS).select("a", "b")

    # the same five bytes are reached from several lists; the one without the last position stands for all
    packed = finer.where((F.col("n") > long_list) & (F.col("p") > _listed([max(positions) for positions in LISTS], choice)))
    dealt = packed.select("list", "p", "byte", "fp").repartition("list", "p", "byte").sortWithinPartitions("list", "p", "byte")
    return links.unionByName(dealt.mapInArrow(_long_list_links, "a long, b long"))


def masked_links(values: np.ndarray) -> list[tuple[int, int]]:
    """Fewer links than ``values`` (distinct, unsigned) that connect all pairs at ``MAX_BITS``
    or fewer differing bits: what agrees outside of a mask of so many bits is linked."""
    differ = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [i for i in range(64) if differ >> i & 1]
    component, left, links = np.arange(len(values)), len(values), []
    masks = combinations(bits, min(MAX_BITS, len(bits)))
    # masks that share few bits come first: a dense list hangs together after some
    for chosen in chain(zip(*(bits[i::MAX_BITS] for i in range(MAX_BITS))), masks):
        if left == 1:
            break
        rest = values & ~np.uint64(sum(1 << i for i in chosen))
        order = np.argsort(rest, kind="stable")
        same = np.flatnonzero(rest[order][1:] == rest[order][:-1])
        x, y = order[same], order[same + 1]
        apart = component[x] != component[y]
        if not apart.any():
            continue
        root: dict[int, int] = {}

        def find(c):
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            a, b = find(int(component[i])), find(int(component[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
                left -= 1
        names, place = np.unique(component, return_inverse=True)
        component = np.array([find(c) for c in names.tolist()])[place]
    return links


def _long_list_links(batches):
    """Links of sorted ``(list, p, byte, fp)``: one list of at most 2**24 fingerprints at a time."""

    def linked(parts):
        values = np.concatenate(parts).view(np.uint64)
        pairs = np.array(masked_links(values), np.int64).reshape(-1, 2)
        signed = values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], ["a", "b"])

    key, parts = None, []
    for batch in batches:
        names = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
        fps = batch.column(3).to_numpy()
        edges = np.r_[0, np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1, len(names)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if low == high:
                continue
            if parts and tuple(names[low]) != key:
                yield linked(parts)
                parts = []
            key = tuple(names[low])
            parts.append(fps[low:high])
    if parts:
        yield linked(parts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each input row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest
    id that can be reached over links, the row's own included.  Null, empty and
    blank texts have fingerprint zero and are linked to each other.  Rows with a
    null id take part; they get the smallest non-null id of their component,
    null if it has none.  Repeated rows come out as often as they came in.
    """
    prints = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(prints, long_list)
    smallest = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    by_print = cut(rooted.join(smallest, "root").select("fp", "component_id"), "by_print")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(prints: DataFrame, long_list: int) -> DataFrame:
    """``(fp, first_id, root)`` for each distinct fingerprint, ``root`` one fingerprint of its component."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), long_list))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return cut(rooted, "rooted")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """One row of each component, with the columns it came with, whatever their names: that
    of the smallest id, of its texts the one of the smallest key.  A component without
    ids keeps a row as well, and an id with texts in several components stays in
    each that it leads.  Null, empty and blank texts are one component; of rows
    with equal id and text one stays; an empty table gives no rows."""
    key = row_key(column(id_col), column(text_col))
    row = F.struct(column(id_col).isNull().alias("none"), column(id_col).alias("id"), key.alias("key"))
    prints = cut(fingerprints(docs.select(row.alias("row"), column(text_col).alias("text")), "row", "text"), "fingerprints")
    first = _rooted(prints, long_list).groupBy("root").agg(F.min("first_id").alias("first"))
    stays = cut(first.select(F.col("first.key").alias("stays")), "stays")
    # a plain equality, so that the join and the removal of repeats share one exchange of the texts;
    # the row is one column, so that its own columns may have any name
    whole = docs.select(key.alias("key"), packed(docs).alias("row"))
    kept = whole.join(stays, F.col("key") == F.col("stays"), "left_semi").dropDuplicates(["key"])
    return kept.select(*unpacked(docs, F.col("row")))
