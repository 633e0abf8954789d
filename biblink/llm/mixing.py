"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's share of all tokens, raised to an exponent between 1 (as it is) and
0 (all equal) and normalised, is its weight.  The exponent is the largest one
that reaches a target entropy, but not below the smallest that keeps every
source within a repetition limit; both are found by bisection over per-source
totals.  Each source's tokens are then dealt out in block permutations: rows go
to blocks of bounded size by hash, each block has its part of the source's
budget, and takes whole passes over its rows in hash order and then rows until
its budget is met.  No task orders more than one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, cut

ENTROPY_SHARE, MAX_EPOCHS, BLOCK_ROWS = 0.9, 4.0, 1024
BISECTIONS = 32
#: Bisection steps that one pass over the totals settles.
_STEPS = 4


def token_count(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _largest(totals: DataFrame, holds) -> float | None:
    """Largest exponent in [0, 1] at which ``holds(exponent)`` is true, for an aggregate
    that is true up to some exponent: 1 if always, 0 if never."""

    def test(points):
        return totals.agg(*[holds(p).alias(f"p{i}") for i, p in enumerate(points)]).first()

    if test([1.0])[0]:
        return 1.0
    low, size = 0.0, 1.0
    for _ in range(BISECTIONS // _STEPS):
        size /= 2**_STEPS
        points = [low + i * size for i in range(1, 2**_STEPS)]
        low += size * sum(1 for x in test(points) if x)
    return low


def _entropy(exponent: float) -> Column:
    """Entropy of the normalised weights, in nats."""
    w = F.pow("share", F.lit(exponent))
    total = F.sum(w)
    return F.log(total) - F.sum(w * F.lit(exponent) * F.log("share")) / total


def source_weights(totals: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``totals(source, tokens, n_rows)`` to ``(source, tokens, n_rows, exponent, weight, quota)``.

    ``budget`` tokens (all tokens by default) are dealt by weight.  The exponent
    is the largest whose entropy is at least ``entropy_share`` of that of equal
    weights; if a source then came more than ``max_epochs`` times, the exponent
    is raised to the smallest that keeps the limit.  A budget of more than
    ``max_epochs`` times all tokens can't keep it and is refused.  Sources
    without tokens get nothing; an empty table gives an empty result.
    """
    some = totals.where("tokens > 0")
    whole = some.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return totals.limit(0).select("source", "tokens", "n_rows", F.lit(0.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota"))
    all_tokens = int(whole["tokens"])
    budget = all_tokens if budget is None else budget
    if budget > max_epochs * all_tokens:
        raise ValueError(f"a budget of {budget} tokens needs more than {max_epochs} passes over {all_tokens}")
    shared = cut(some.withColumn("share", F.col("tokens") / F.lit(float(all_tokens))), "shares")
    target = entropy_share * math.log(whole["n"])
    exponent = _largest(shared, lambda a: _entropy(a) >= F.lit(target))
    # the rarest source comes most often: budget * weight / tokens, falling as the exponent rises
    often = lambda a: F.lit(budget / all_tokens) * F.max(F.pow("share", F.lit(a - 1.0))) / F.sum(F.pow("share", F.lit(a)))
    if shared.agg(often(exponent).alias("x")).first()["x"] > max_epochs:
        over = _largest(shared, lambda a: often(a) > F.lit(max_epochs))
        exponent = min(1.0, over + 2.0**-BISECTIONS)
    norm = shared.agg(F.sum(F.pow("share", F.lit(exponent))).alias("s")).first()["s"]
    weighted = shared.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(norm))
    return weighted.select("source", "tokens", "n_rows", F.lit(exponent).alias("exponent"), "weight", (F.col("weight") * F.lit(float(budget))).alias("quota"))


def _hash(*columns) -> Column:
    return F.md5(F.concat_ws("|", *columns).cast("binary"))


def _number(hexed: Column, start: int) -> Column:
    return F.conv(F.substring(hexed, start, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    entropy_share: float = ENTROPY_SHARE,
    max_epochs: float = MAX_EPOCHS,
    block_rows: int = BLOCK_ROWS,
    seed: str = "mix",
) -> DataFrame:
    """``(doc_id, source, n_tokens, weight, epoch, block, position)``: the mixture in order.

    A row comes once for each epoch it takes part in.  ``block`` and ``position``
    order a source's epoch.  A null source is one source of its own (shown as
    null); texts without words are never dealt.  Repeated rows are dealt one by
    one, and so are rows that share an id or have none.  A block's last epoch
    stops at the row nearest to the block's budget.  The order follows from the
    ids and the rows' numbers in the table as it is split.  Other columns are
    not read; an empty table gives no rows.
    """
    read = docs.select(column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), token_count(column(text_col)).alias("n_tokens"))
    numbered = read.withColumn("row", F.monotonically_increasing_id())
    # the row's number takes part: rows of one id, or without an id, go to all blocks of their source
    rows = cut(numbered.withColumn("h", _hash(F.lit(seed), F.col("doc_id").cast("string"), F.col("row").cast("string"))), "tokens").where("n_tokens > 0")
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"))
    weights = cut(source_weights(cut(totals, "totals"), budget, entropy_share, max_epochs), "weights")

    same = F.col("source").eqNullSafe(F.col("w_source"))
    per_source = weights.select(F.col("source").alias("w_source"), "tokens", "n_rows", "weight", (F.col("quota") / F.col("tokens")).alias("passes"))
    blocked = (
        rows.join(per_source, same)
        .withColumn("blocks", F.ceil(F.col("n_rows") / F.lit(block_rows)).cast("long"))
        .withColumn("block", F.pmod(_number(F.col("h"), 1), F.col("blocks")))
        .withColumn("full", F.floor("passes"))
        .select("doc_id", "source", "n_tokens", "row", "h", "weight", "block", "full", (F.col("passes") - F.col("full")).alias("part"))
    )
    in_block = W.partitionBy("source", "block")
    # the last, partial epoch of a block takes rows in the order of another hash
    last = in_block.orderBy("h2", "row")
    dealt = (
        blocked.withColumn("h2", _hash("h", F.col("full").cast("string")))
        .withColumn("before", F.sum("n_tokens").over(last) - F.col("n_tokens"))
        .withColumn("in_last", F.col("before") + F.col("n_tokens") / 2.0 <= F.col("part") * F.sum("n_tokens").over(in_block))
        .withColumn("epochs", F.col("full") + F.when(F.col("in_last"), 1).otherwise(0))
        .where("epochs > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    )
    order = W.partitionBy("source", "block", "epoch").orderBy(_hash("h", F.col("epoch").cast("string")), "row")
    return dealt.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", F.row_number().over(order).alias("position"))
