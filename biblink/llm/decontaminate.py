"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one partition, up to ``SHARD_WORDS`` words.
Its text is the sequence of word numbers over the benchmark's vocabulary; a
word that no benchmark phrase has can't lie in an occurrence, so it only
separates, and stretches shorter than the shortest phrase are left out (exact:
they can't hold a phrase).  The index has the suffix array's Burrows-Wheeler
transform as a wavelet tree of ranked bit vectors, cumulative symbol counts,
and every ``SAMPLE``-th text position's row.  Phrases are searched backward,
all at once; their rows walk to a sampled position; spans merge per document.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER_WORDS, column, cut, lower_words, packed, small_batches, unpacked

WINDOW_WORDS = 10
SHARD_WORDS = 1_000_000
SAMPLE = 8
#: Benchmark words, about, that are broadcast at once: 40 bytes of windows and 8 of items for
#: each, and 150 at most of vocabulary, so some 50 MB in the driver and in a worker.  A
#: larger benchmark is searched in several passes over the documents.
PART_WORDS = 250_000
#: Windows in one piece of an item; pieces are dealt to the parts.
PIECE_WINDOWS = 4096
#: The words of a lower-cased text, as a pattern.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = np.empty(n, np.int64)
    firsts = np.flatnonzero(np.r_[True, text[order][1:] != text[order][:-1]])
    ranks[order] = np.repeat(firsts, np.diff(np.r_[firsts, n]))
    h = 1
    while True:
        # a group of ties begins at its members' rank
        size = np.bincount(ranks, minlength=n)
        tied = order[size[ranks[order]] > 1]
        if not len(tied):
            return order
        after = np.where(tied + h < n, ranks[np.minimum(tied + h, n - 1)] + 1, 0)
        by = np.lexsort((after, ranks[tied]))
        tied, after = tied[by], after[by]
        group = ranks[tied]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        inside = np.arange(len(tied)) - np.repeat(starts, np.diff(np.r_[starts, len(tied)]))
        order[group + inside] = tied
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        heads = np.flatnonzero(new)
        ranks[tied] = np.repeat((group + inside)[heads], np.diff(np.r_[heads, len(tied)]))
        h *= 2


class WaveletTree:
    """Symbols split by bits from the highest; each level is one bit vector with ranks."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.r_[current[bit == 0], current[bit == 1]]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``i`` positions."""
        start = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[i + 1] - ones[i]
            symbol = symbol * 2 + one
            i = np.where(one == 1, zeros + ones[i], i - ones[i])
        return symbol


class FMIndex:
    """``text``: symbols from 1; a terminal 0 is added."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.r_[text, 0].astype(np.int64)
        order = suffix_array(text)
        self.bwt = WaveletTree(text[order - 1], sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))].astype(np.int64)
        self.sampled = order % sample == 0
        self.sample_rank = np.r_[0, np.cumsum(self.sampled)]
        self.samples = order[self.sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, one phrase a row, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            low, high = self.before[c] + self.bwt.rank(c, low), self.before[c] + self.bwt.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled row, counted."""
        out, steps, at, todo = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.samples[self.sample_rank[at[done]]] + steps
            at, todo = at[~done], todo[~done]
            if len(todo):
                c = self.bwt.access(at)
                at = self.before[c] + self.bwt.rank(c, at)
            steps += 1
        return out


class Phrases:
    """Windows of the benchmark items as word numbers, by length, with the items that have
    them; all but the vocabulary in flat arrays."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW_WORDS):
        self.number: dict[bytes, int] = {}
        self.item_ids = [item_id for item_id, _ in items]
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for place, (_, text) in enumerate(items):
            words = np.array([self.number.setdefault(w, len(self.number) + 2) for w in lower_words(text)], np.int32)
            if len(words):
                n = min(window, len(words))
                found = np.lib.stride_tricks.sliding_window_view(words, n)
                rows.setdefault(n, []).append(found)
                owners.setdefault(n, []).append(np.full(len(found), place, np.int32))
        #: by length: distinct windows, where each one's items begin, and the items' places
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted(rows):
            windows, which = np.unique(np.concatenate(rows[n]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owners[n])], 1), axis=0)
            self.by_length[n] = windows, np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1].astype(np.int32)
        self.shortest = min(self.by_length, default=0)

    @classmethod
    def of(cls, fields: dict) -> Phrases:
        """From the fields of another, as broadcast."""
        new = cls.__new__(cls)
        vars(new).update(fields)
        return new


def search_shard(docs: list[bytes | None], phrases: Phrases):
    """For each document: its number of words, merged hit spans ``[start, end)`` and the items that occur."""
    counts, texts, owner, at = [], [], [], []
    get = phrases.number.get
    for d, text in enumerate(docs):
        words = lower_words(text)
        counts.append(len(words))
        if not phrases.by_length or not words:
            continue
        known = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.r_[0, known > 0, 0].astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= phrases.shortest:
                texts.append(np.r_[known[s:e], 1])
                owner.append(d)
                at.append(s)
    spans: list[list] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]
    if texts:
        begins = np.cumsum([0, *(len(t) for t in texts)])
        index = FMIndex(np.concatenate(texts), len(phrases.number) + 2)
        for n, (patterns, begin, having) in phrases.by_length.items():
            low, high = index.search(patterns)
            hit = np.flatnonzero(high > low)
            many = (high - low)[hit]
            rows = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            places = index.locate(rows)
            runs = np.searchsorted(begins, places, "right") - 1
            for which, place, run in zip(np.repeat(hit, many).tolist(), places.tolist(), runs.tolist()):
                start = at[run] + place - int(begins[run])
                spans[owner[run]].append((start, start + n))
                items[owner[run]].update(phrases.item_ids[i] for i in having[begin[which] : begin[which + 1]])
    return counts, [merge_spans(s) for s in spans], items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the separators that follow them inside the span."""
    if not spans:
        return text
    word = np.frombuffer(text.translate(LOWER_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[0, word, 0].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, text[at:]])


def _shards(batches, text_column: int, shard_words: int):
    """Row groups whose texts hold about ``shard_words`` words (a word and its separator: 6 bytes)."""
    rows, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_pylist()
        start = 0
        for i, length in enumerate(lengths):
            size += length
            if size >= 6 * shard_words:
                rows.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(rows).combine_chunks()
                rows, size, start = [], 0, i + 1
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks()


_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


_SPANS_TYPE = T.ArrayType(T.StructType().add("s", "long").add("e", "long"))


def _spans_column(spans) -> pa.Array:
    return pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], _SPANS)


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``(item_id, at, n, text)``: an item's words in pieces that overlap by a window less one
    word, so that each window lies in one of them."""
    words = F.regexp_extract_all(F.translate(F.coalesce(column(text_col), F.lit("")), _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))
    items = benchmark.select(column(item_col).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE_WINDOWS))
    cut_up = items.select("item_id", "words", F.explode(at).alias("at")).select("item_id", "at", F.slice("words", F.col("at") + 1, F.lit(PIECE_WINDOWS + window - 1)).alias("words"))
    return cut(cut_up.select("item_id", "at", F.size("words").alias("n"), F.array_join("words", " ").alias("text")), "pieces")


def _shared_parts(pieces: DataFrame, window: int, part_words: int):
    """The phrases of each part of the benchmark, broadcast; one part without phrases if it is empty."""
    spark = pieces.sparkSession
    parts = max(1, -(-int(pieces.agg(F.sum("n").alias("n")).first()["n"] or 0) // part_words))
    for part in range(parts):
        chosen = pieces if parts == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "at"), F.lit(parts)) == part)
        # about part_words words, as checked above
        phrases = Phrases([(r["item_id"], r["text"].encode()) for r in chosen.select("item_id", "text").collect()], window)
        yield spark.sparkContext.broadcast(vars(phrases))


def _search(rows: DataFrame, item_type: T.DataType, shared, shard_words: int) -> DataFrame:
    """``rows(row, text)`` to ``(row, n_words, spans, items)`` for one part of the benchmark."""
    item_arrow = to_arrow_type(item_type)

    def run(batches):
        phrases = Phrases.of(shared.value)
        for shard in _shards(batches, 1, shard_words):
            counts, spans, hits = search_shard(shard.column(1).cast(pa.binary()).to_pylist(), phrases)
            columns = [shard.column(0).combine_chunks(), pa.array(counts, pa.int64()), _spans_column(spans), pa.array([[i for i in x if i is not None] for x in hits], pa.list_(item_arrow))]
            yield from pa.Table.from_arrays(columns, ["row", "n_words", "spans", "items"]).to_batches()

    out = T.StructType().add("row", rows.schema["row"].dataType).add("n_words", "long").add("spans", _SPANS_TYPE).add("items", T.ArrayType(item_type))
    return rows.mapInArrow(run, out)


def _merge_parts(found: list[DataFrame]) -> DataFrame:
    """Spans and items of one row from all parts of the benchmark, brought together."""
    if len(found) == 1:
        return found[0]
    all_parts = found[0]
    for more in found[1:]:
        all_parts = all_parts.unionByName(more)
    return all_parts.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    shard_words: int = SHARD_WORDS,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """``(doc_id, n_words, spans, items)``, one row for each document row.

    ``spans`` are the word spans ``[s, e)`` inside occurrences, merged (those of
    different parts of a large benchmark may overlap); ``items`` the items
    with an occurring window, null item ids left out.  Null texts have no words;
    repeated rows each get a row; an empty benchmark gives no spans, an empty
    table no rows.  Columns other than those named are not read.
    """
    small_batches(docs.sparkSession)
    pieces = _pieces(benchmark, item_col, item_text_col, window)
    item_type = benchmark.schema[item_col].dataType
    source = docs.select(column(id_col).alias("row"), column(text_col).alias("text"))
    parts = list(_shared_parts(pieces, window, part_words))
    if len(parts) == 1:
        return _search(source, item_type, parts[0], shard_words).withColumnRenamed("row", "doc_id")
    numbered = cut(source.select(F.struct(F.monotonically_increasing_id().alias("at"), F.col("row").alias("doc_id")).alias("row"), "text"), "rows")
    found = _merge_parts([_search(numbered, item_type, part, shard_words) for part in parts])
    return found.select("row.doc_id", "n_words", "spans", "items")


def hit_words(spans) -> F.Column:
    """Words inside any span; the spans may overlap."""
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def contamination_report(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`contamination`."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cleaned(texts: pa.Array, spans) -> pa.Array:
    """Texts without the words of their spans; null stays null."""
    found = [None if t is None else remove_spans(t, s) for t, s in zip(texts.cast(pa.binary()).to_pylist(), spans)]
    return pa.array(found, pa.binary()).cast(pa.string())


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    shard_words: int = SHARD_WORDS,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """The same rows and columns, whatever the names of the others, with the words of every
    occurrence removed from the text.

    A null text stays null; a text that is all benchmark becomes empty but for
    its separators; repeated rows are cleaned alike; an empty benchmark changes
    nothing, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    pieces = _pieces(benchmark, item_col, item_text_col, window)
    item_type = benchmark.schema[item_col].dataType
    source = docs.select(packed(docs, (text_col,)).alias("row"), column(text_col).alias("text"))
    out = T.StructType().add("row", source.schema["row"].dataType).add("text", "string")
    parts = list(_shared_parts(pieces, window, part_words))

    def search_and_clean(batches):
        phrases = Phrases.of(parts[0].value)
        for shard in _shards(batches, 1, shard_words):
            texts = shard.column(1).combine_chunks()
            _, spans, _ = search_shard(texts.cast(pa.binary()).to_pylist(), phrases)
            yield from pa.Table.from_arrays([shard.column(0).combine_chunks(), _cleaned(texts, spans)], ["row", "text"]).to_batches()

    def clean(batches):
        for batch in batches:
            spans = [merge_spans([(x["s"], x["e"]) for x in s or ()]) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _cleaned(batch.column(1), spans)], ["row", "text"])

    if len(parts) == 1:
        cleaned = source.mapInArrow(search_and_clean, out)
    else:
        numbered = cut(source.select(F.monotonically_increasing_id().alias("row"), F.col("row").alias("cells"), "text"), "rows")
        spans = _merge_parts([_search(numbered.select("row", "text"), item_type, part, shard_words) for part in parts])
        cleaned = numbered.join(spans, "row").select("cells", "text", "spans").mapInArrow(clean, out)
    return cleaned.select(*unpacked(docs, F.col("row"), {text_col: F.col("text")}))
