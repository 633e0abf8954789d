"""Connected components by alternating large-star and small-star steps.

Both steps only need, for each node, its smallest neighbour: a partial
aggregate, so a hub of any degree costs one row per task.  The edges then
learn that minimum through a join against the cut (stored) minima, whose
skewed side adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _canonical(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")), "minima").select(F.col("u").alias("node"), "m")


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(pairs: DataFrame, name: str = "components") -> DataFrame:
    """``pairs(a long, b long)`` to ``(node, root)``, root the smallest node that
    can be reached.  Nodes without a link are absent; loops and repeats are
    ignored; an empty input gives an empty result."""
    edges = cut(_canonical(pairs), name)
    before = _state(edges)
    while True:
        # large star: the larger end of each link goes to the smallest neighbour of the other end
        low = _smallest(edges)
        edges = cut(
            edges.join(low, F.col("v") == F.col("node"), "left").select(F.col("u").alias("a"), F.coalesce("m", "v").alias("b")).transform(_canonical),
            name,
        )
        # small star: all smaller neighbours of a node, and itself, go to the smallest of them
        low = _smallest(edges)
        linked = edges.join(low, F.col("u") == F.col("node")).select("u", "v", "m")
        edges = cut(
            linked.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .transform(_canonical),
            name,
        )
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
