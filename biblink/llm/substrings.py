"""Exact substring dedup by level-wise doubling of repeated word windows.

Windows of ``window`` words that occur twice are found through shorter ones:
lengths double from about a quarter of the window up to it, and only windows
whose shorter part is repeated are extended to twice its length.  Below the
full length each window is judged by one part of it, its minimizer: the part
with the smallest hash.  Equal windows have equal minimizers at equal offsets,
so a window whose minimizer isn't repeated can't be repeated either.

Texts are gathered in chunks, exchanged once and stored in buckets.  At each
level a chunk sends one row for each distinct hash of its surviving parts; rows
of equal hashes meet in a sort that may spill, and those that another chunk has
too go back to their chunks.  A hash that is frequent anywhere comes once from
each chunk; rows grow with the text, and no task holds more than a chunk's.

Hashes of parts only choose candidates.  The last level compares 128 bits, of
two unlike combinations of the words' 64-bit hashes: at 10**14 windows a false
match is expected less than once in 10**10 runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, cut, cut_bucketed, small_batches

WINDOW_WORDS = 35
CHUNK_BYTES = 2 << 20
#: Text in one bucket of the stored chunks.
BUCKET_BYTES = 128 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: For the second combination of the last level.
_C, _D = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def level_lengths(window: int) -> list[int]:
    """Part lengths, shortest first: each at most twice the one before, the last the window."""
    return sorted({-(-window // 4), -(-window // 2), window})


def _pair(left: np.ndarray, right: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """Hash of two hashed parts, in order."""
    x = (left ^ (left >> np.uint64(29))) * a + (right ^ (right >> np.uint64(31))) * b
    x ^= x >> np.uint64(32)
    x *= b
    return x ^ (x >> np.uint64(29))


def _to_length(h: np.ndarray, n: int, to: int, a: np.uint64 = _A, b: np.uint64 = _B) -> np.ndarray:
    """Hashes of ``n``-word parts to hashes of ``to``-word parts; those that would pass the end are of no use."""
    while n < to:
        by = min(n, to - n)
        out = h.copy()
        out[: len(h) - by] = _pair(h[: len(h) - by], h[by:], a, b)
        h, n = out, n + by
    return h


def _smallest_of(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value among ``width`` values from each position on."""
    n = len(h)
    at, have = np.arange(n), 1
    while have < width:
        by = min(have, width - have)
        here, there = at[: n - by], at[by:]
        at = np.r_[np.where(h[here] <= h[there], here, there), at[n - by :]]
        have += by
    return at


class Chunk:
    """Words, surviving windows and parts of one chunk, replayed from the answers so far.

    Words that no surviving window has are left out after each level.  Parts that
    would then span a gap lie in no surviving window and are never looked at.
    """

    def __init__(self, texts: list[bytes | None], window: int):
        self.words = [(t or b"").split() for t in texts]
        self.window = window
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.total = int(self.lengths.sum())
        self.word = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for ws in self.words for w in ws)), np.uint64, self.total)
        self.place = np.arange(self.total)
        self.alive = self.place + window <= np.repeat(np.cumsum(self.lengths), self.lengths)
        self.h, self.n = self.word, 1
        self._compact()

    def _covered(self) -> np.ndarray:
        edge = np.zeros(len(self.alive) + 1, np.int64)
        starts = np.flatnonzero(self.alive)
        edge[starts] += 1
        np.subtract.at(edge, starts + self.window, 1)
        return np.cumsum(edge)[:-1] > 0

    def _compact(self) -> None:
        keep = self._covered()
        self.word, self.place, self.alive, self.h = self.word[keep], self.place[keep], self.alive[keep], self.h[keep]

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of the level's parts, in order, and their second halves at the
        last level (else zeros); remembers which are repeated within the chunk."""
        self.h, self.n = _to_length(self.h, self.n, n), n
        self.starts = np.flatnonzero(self.alive)
        if n < self.window:
            at = _smallest_of(self.h, self.window - n + 1)[self.starts]
            used = np.zeros(len(self.h), bool)
            used[at] = True
            places, self.which = np.flatnonzero(used), (np.cumsum(used) - 1)[at]
            hashes, second = self.h[places], np.zeros(len(places), np.uint64)
            order = np.argsort(hashes, kind="stable")
        else:
            self.which = np.arange(len(self.starts))
            hashes, second = self.h[self.starts], _to_length(self.word, 1, n, _C, _D)[self.starts]
            order = np.lexsort((second, hashes))
        hashes, second = hashes[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
        self.back = np.empty(len(order), np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.own = np.diff(np.r_[np.flatnonzero(new), len(order)]) > 1
        return hashes[new], second[new]

    def survive(self, elsewhere: np.ndarray) -> None:
        """Keeps windows whose part is repeated here or is among those, by number, that another chunk has."""
        repeated = self.own.copy()
        repeated[elsewhere] = True
        self.alive[self.starts[~repeated[self.back][self.which]]] = False
        self._compact()

    def covered(self) -> np.ndarray:
        """Of all words, which lie in a surviving window."""
        gone = np.zeros(self.total, bool)
        gone[self.place] = True
        return gone


def _pack(texts: list[bytes | None]) -> tuple[bytes, bytes]:
    sizes = np.array([-1 if t is None else len(t) for t in texts], "<i8")
    return sizes.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(t or b"" for t in texts))


def _unpack(sizes: bytes, blob: bytes) -> list[bytes | None]:
    lens = np.frombuffer(sizes, "<i8")
    data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, int(lens.clip(0).sum())))
    ends = np.cumsum(lens.clip(0))
    return [None if n < 0 else data[e - n : e] for n, e in zip(lens.tolist(), ends.tolist())]


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, buckets: int) -> DataFrame:
    """``(chunk, ids, sizes, blob)``: rows of one partition in order, about ``chunk_bytes`` of
    text each, in buckets of ``chunk``: texts are exchanged once and not moved again."""
    source = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("text"))
    kind = to_arrow_type(source.schema["doc_id"].dataType)

    def packed(ids, texts):
        sizes, blob = _pack(texts)
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.binary()), pa.array([blob], pa.binary())], ["ids", "sizes", "blob"])

    def gather(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
                if size >= chunk_bytes:
                    yield packed(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield packed(ids, texts)

    id_type = source.schema["doc_id"].dataType.simpleString()
    made = source.mapInArrow(gather, f"ids array<{id_type}>, sizes binary, blob binary")
    numbered = made.select(F.monotonically_increasing_id().alias("chunk"), "ids", "sizes", "blob")
    # dealt as the buckets are: each task writes one file
    return cut_bucketed(numbered.repartition(buckets, "chunk"), "chunk", buckets, "chunks")


def _replays(batches, window: int, lengths: list[int], known: int):
    """Each row's chunk after the first ``known`` levels, from its answers, with its number and ids."""
    for batch in batches:
        answers = [batch.column(batch.schema.get_field_index(f"a{level}")) for level in range(known)]
        numbers, sizes, blobs = (batch.column(batch.schema.get_field_index(c)) for c in ("chunk", "sizes", "blob"))
        ids = batch.column(batch.schema.get_field_index("ids"))
        for i in range(batch.num_rows):
            chunk = Chunk(_unpack(sizes[i].as_py(), blobs[i].as_py()), window)
            for level in range(known):
                chunk.distinct(lengths[level])
                found = answers[level][i].values
                chunk.survive(found.to_numpy() if found is not None else np.empty(0, np.int64))
            yield numbers[i].as_py(), ids[i].values, chunk


def _sender(window, lengths, level):
    def run(batches):
        for number, _, chunk in _replays(batches, window, lengths, level):
            first, second = (x.view(np.int64) for x in chunk.distinct(lengths[level]))
            for at in range(0, len(first), 1 << 16):
                part = slice(at, at + (1 << 16))
                n = len(first[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[part]), pa.array(second[part]), pa.array(np.full(n, number)), pa.array(np.arange(at, at + n, dtype=np.int32))], ["h", "h2", "chunk", "number"]
                )

    return run


def _finisher(window, lengths):
    def run(batches):
        for _, ids, chunk in _replays(batches, window, lengths, len(lengths)):
            gone, at = chunk.covered(), 0
            removed, kept = [], []
            for words in chunk.words:
                mine = gone[at : at + len(words)]
                at += len(words)
                n = int(mine.sum())
                removed.append(n)
                kept.append(b" ".join(words if not n else [w for w, g in zip(words, mine.tolist()) if not g]))
            for low in range(0, len(kept), 256):
                part = slice(low, low + 256)
                yield pa.RecordBatch.from_arrays(
                    [ids[part], pa.array(chunk.lengths[part]), pa.array(removed[part], pa.int64()), pa.array(kept[part], pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+``; those covered by a ``window``-word window
    whose words also start anywhere else, in the same row included, are
    removed, and ``kept`` has the rest joined by one space.  Windows are judged
    on the input: every copy goes.  Null and empty texts have no words; a
    repeated row is a copy of the other; null and repeated ids stay as they
    are; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lengths = level_lengths(window)
    id_type = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    known = _chunks(docs, id_col, text_col, chunk_bytes, buckets)

    for level in range(len(lengths)):
        sent = known.mapInArrow(_sender(window, lengths, level), "h long, h2 long, chunk long, number int")
        by_hash = W.partitionBy("h", "h2") if level == len(lengths) - 1 else W.partitionBy("h")
        shared = sent.withColumn("n", F.count("*").over(by_hash)).where("n > 1").select("chunk", "number")
        answer = shared.groupBy(F.col("chunk").alias("answered")).agg(F.collect_list("number").alias(f"a{level}"))
        if level < len(lengths) - 1:
            # read by every later level; the last one's is read once
            answer = cut(answer, f"answers-{level}")
        known = known.join(answer.hint("shuffle_hash"), F.col("chunk") == F.col("answered"), "left").drop("answered")
    return known.mapInArrow(_finisher(window, lengths), f"doc_id {id_type}, n_words long, n_removed long, kept string")
