"""Streams of a running review: learned counts and verdicts that are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from redactrail.operators import diff


def learned_counts(tokens: DataFrame) -> DataFrame:
    """diff.learned() of a stream of (app, left, token, kept): for output mode update or complete."""
    return diff.learned(tokens)


def verdict_table(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of verdict records to a table that review.verdicts() reads; each record is written once.

    A batch that is run again overwrites what it wrote before, for batches have their own partitions.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(log: DataFrame) -> DataFrame:
    """The last record of each (sid, left) of a stream, for output mode update or complete."""
    record = F.struct("viewed", "reviewed", "comments")
    return log.groupBy("sid", "left").agg(F.max_by(record, "seq").alias("record"), F.max("seq").alias("seq"))
