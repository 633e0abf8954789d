"""New references resolved as they come: each micro-batch goes through the batch cascade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse_references
from ..operators.resolve import resolve


def resolve_stream(raw_refs: DataFrame, candidates: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, ref_keys=("doc_id", "n"), cand_key: str = "cid", available_now: bool = False) -> StreamingQuery:
    """``raw_refs`` streams ``(ref_keys, raw)``; ``sink`` gets each batch's resolutions and
    its number, and may see a batch again after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(resolve(parse_references(batch), candidates, list(ref_keys), cand_key), number)

    writer = raw_refs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
