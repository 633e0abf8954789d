"""Exact top-k inner products by distributed histogram selection.

Vectors become integers, ``floor(scale * x)``.  Candidates are dealt to groups
that fit in memory, query blocks go to every group, and scores are matrix
products: a group's vectors are held once and each query block passes over them.
A pass counts the scores in each query's open interval in equal bins and sends
one packed histogram for each query block and group.  The histograms of a block
are summed, and the bin that holds the k-th largest score becomes the query's
next interval, until it is one score wide.  A last pass keeps scores above the
k-th value and, of each group's ties with it, the smallest ids; a ranked window
then breaks ties by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SCALE, BINS = 1024, 4096
QUERY_BLOCK, CANDIDATE_BLOCK = 128, 2048
#: Most bytes of candidate vectors in one group; a task holds them at once.
GROUP_BYTES = 64 << 20
#: Largest sum of products that float64 holds exactly.
_EXACT = 2.0**53
_LIMIT = 2**62
_BELOW = -_LIMIT - 1
_BLOCK = "qb long, ids binary, m binary, low binary, need binary"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, v array<double>)``: whole numbers ``floor(scale * x)``.  Rows whose id or
    vector is null, or whose vector holds a null or non-finite component, go."""
    x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(F.col("id").isNotNull() & F.col("x").isNotNull() & good).select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column, zero-padded to ``dim``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    out[rows, np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def _packer(rows: int, dim: int, extra: tuple[str, ...]):
    """Packs rows into blocks of at most ``rows``: ids, matrix and extra long columns as bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = _matrix(part.column(1), dim)
                cols = [part.column(0).to_numpy().astype("<i8").tobytes(), m.astype("<f8").tobytes()]
                cols += [part.column(2 + i).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for i in range(len(extra))]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], ["ids", "m", *extra])

    return run


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in machine floats where they are exact, else in
    Python's integers, held to +-2**62."""
    bound = np.abs(q).sum(1).max(initial=0) * np.abs(c).max(initial=0)
    if bound < _EXACT:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], object).dot(np.array([[int(x) for x in row] for row in c], object).T)
    return np.clip(exact, -_LIMIT, _LIMIT).astype(np.int64)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _rows(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


class _Group:
    """Candidates of one group, gathered before its query blocks come."""

    def __init__(self, g: int):
        self.g, self.ids, self.vectors = g, [], []

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def scores(self, q_ids: np.ndarray, queries: np.ndarray):
        """For each block of candidates: their ids, the scores, and where the pair isn't a query with itself."""
        for ids, vectors in zip(self.ids, self.vectors):
            yield ids, _products(queries, vectors), q_ids[:, None] != ids[None, :]


def _over_groups(dim: int, work):
    """Runs ``work(group, row)`` for the query blocks of sorted ``(g, asks, ...)`` rows,
    which a group's candidates precede."""

    def run(batches):
        group = None
        for batch in batches:
            for row in batch.to_pylist():
                if group is None or group.g != row["g"]:
                    group = _Group(row["g"])
                if row["asks"]:
                    yield work(group, row)
                else:
                    group.add(_longs(row["ids"]), _rows(row["m"], dim))

    return run


def _counter(dim: int, bins: int, width: int):
    """A query block's scores in one group, counted by query and bin: places and counts of what isn't zero."""

    def work(group: _Group, row: dict) -> pa.RecordBatch:
        q_ids, low = _longs(row["ids"]), _longs(row["low"])
        counts = np.zeros(len(q_ids) * bins, np.int64)
        for _, scores, other in group.scores(q_ids, _rows(row["m"], dim)):
            b = (scores - low[:, None]) // width
            inside = other & (b >= 0) & (b < bins)
            counts += np.bincount((np.arange(len(q_ids))[:, None] * bins + b)[inside], minlength=len(counts))
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([row["qb"]], pa.int64()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (at, counts[at]))], ["qb", "at", "n"])

    return _over_groups(dim, work)


def _narrower(bins: int, width: int, k: int):
    """Sums the histograms of each block and moves its queries to the bin of their k-th
    score; without such a bin a query has fewer than k candidates and keeps all."""

    def moved(block: dict, counts: np.ndarray) -> pa.RecordBatch:
        low, need = _longs(block["low"]), _longs(block["need"])
        by_query = counts.reshape(len(low), bins)[:, ::-1]
        reached = by_query.cumsum(1)
        found = reached[:, -1] >= need
        first = (reached >= need[:, None]).argmax(1)
        above = np.where(first > 0, np.take_along_axis(reached, np.maximum(first - 1, 0)[:, None], 1)[:, 0], 0)
        new_low = np.where(found & (low != _BELOW), low + (bins - 1 - first) * width, _BELOW)
        new_need = np.where(found, need - above, k)
        columns = [pa.array([block["qb"]], pa.int64()), *(pa.array([x], pa.binary()) for x in (block["ids"], block["m"], new_low.astype("<i8").tobytes(), new_need.astype("<i8").tobytes()))]
        return pa.RecordBatch.from_arrays(columns, ["qb", "ids", "m", "low", "need"])

    def run(batches):
        block, counts = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["at"] is None:
                    # a block comes before its histograms
                    if block is not None:
                        yield moved(block, counts)
                    block, counts = row, np.zeros(len(_longs(row["low"])) * bins, np.int64)
                else:
                    counts[_longs(row["at"])] += _longs(row["n"])
        if block is not None:
            yield moved(block, counts)

    return run


def _keeper(dim: int, k: int):
    """Scores above each query's k-th value, and of a group's ties with it the k smallest ids."""

    def work(group: _Group, row: dict) -> pa.RecordBatch:
        q_ids, low = _longs(row["ids"]), _longs(row["low"])
        found = []
        for ids, scores, other in group.scores(q_ids, _rows(row["m"], dim)):
            i, j = np.nonzero(other & (scores >= low[:, None]))
            found.append(np.stack([i, ids[j], scores[i, j]]))
        i, ids, scores = np.concatenate(found, 1) if found else np.empty((3, 0), np.int64)
        order = np.lexsort((ids, scores > low[i], i))
        i, ids, scores = i[order], ids[order], scores[order]
        ties = scores == low[i]
        # within a query ties come first, by id
        before = np.searchsorted(i, i)
        keep = ~ties | (np.arange(len(i)) - before < k)
        return pa.RecordBatch.from_arrays([pa.array(q_ids[i[keep]]), pa.array(ids[keep]), pa.array(scores[keep])], ["query_id", "vec_id", "score"])

    return _over_groups(dim, work)


def _intervals(span: int, bins: int) -> tuple[int, int]:
    """Number of passes and of bins in each, at most ``bins``, that narrow ``span`` values to one."""
    passes = 1
    while bins**passes < span:
        passes += 1
    used = max(2, round(span ** (1 / passes)))
    while used**passes < span:
        used += 1
    return passes, used


def exact_top_k(
    vectors: DataFrame,
    k: int = 10,
    query_divisor: int = 100,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = SCALE,
    bins: int = BINS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest scores of every row whose id
    is divisible by ``query_divisor``, against all other rows.

    Ties go to the smaller id; with fewer than ``k`` candidates all are returned.
    Null or non-finite vectors and null ids take no part.  Vectors of unequal
    length are compared over zero-padded components; an empty vector scores 0.
    Rows that repeat a query's id count as that query's own; of several rows
    with one query id the smallest vector asks.  Repeated candidates each count.
    Columns other than the two named are not read.
    """
    spark = vectors.sparkSession
    ints = cut(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    queries = ints.where(F.col("id") % query_divisor == 0).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    seen = ints.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("norm"), F.count("*").alias("n")).first()
    if seen["dim"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, seen["dim"])
    # no score is beyond the largest squared norm
    top = min(int(seen["norm"]) + 1, _LIMIT)
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] * dim * 8 // group_bytes))

    blocks = cut(ints.mapInArrow(_packer(CANDIDATE_BLOCK, dim, ()), "ids binary, m binary"), "candidates")
    dealt = blocks.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("qb"), "ids", "m", F.lit(None).cast("binary").alias("low"))

    def over_groups(state: DataFrame, step, out: str) -> DataFrame:
        asked = state.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("asks"), "qb", "ids", "m", "low")
        return dealt.unionByName(asked).repartition(groups, "g").sortWithinPartitions("g", "asks").mapInArrow(step, out)

    passes, bins = _intervals(2 * top + 1, bins)
    begin = queries.select("id", "v", F.lit(-top).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    packed = begin.mapInArrow(_packer(QUERY_BLOCK, dim, ("low", "need")), "ids binary, m binary, low binary, need binary")
    state = cut(packed.select(F.monotonically_increasing_id().alias("qb"), "ids", "m", "low", "need"), "state")
    for step in range(passes - 1, -1, -1):
        width = bins**step
        counts = cut(over_groups(state, _counter(dim, bins, width), "qb long, at binary, n binary"), "histograms")
        nothing = F.lit(None).cast("binary")
        both = state.select("*", nothing.alias("at"), nothing.alias("n")).unionByName(counts, allowMissingColumns=True)
        state = cut(both.repartition("qb").sortWithinPartitions("qb", F.col("at").isNotNull()).mapInArrow(_narrower(bins, width, k), _BLOCK), "state")
    kept = over_groups(state, _keeper(dim, k), "query_id long, vec_id long, score long")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
