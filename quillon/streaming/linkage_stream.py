"""Reference records as a stream, matched against static postings; an addition to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking, features, records, resolve


def match_batch(s1: DataFrame, pool: DataFrame, threshold: float, caps: dict[str, int] | None = None) -> DataFrame:
    """Matches of one batch of raw records against derived pool records."""
    rec = records.derive(s1)
    pairs = blocking.block(rec, pool, *([caps] if caps else []))
    scored = features.linear_score(features.pair_up(pairs, rec, pool))
    return resolve.resolve(scored.join(rec.selectExpr("entity_id as s1_id", "country"), "s1_id"), threshold)


def start(stream: DataFrame, pool: DataFrame, target: str, checkpoint: str, threshold: float = 0.5) -> StreamingQuery:
    """Writes each micro-batch's matches under its own folder, so a repeated batch replaces itself."""

    def sink(batch: DataFrame, epoch: int) -> None:
        match_batch(batch, pool, threshold).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
