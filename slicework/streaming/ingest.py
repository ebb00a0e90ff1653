"""Structured Streaming: files that are new since the last run, and metrics by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slicework.operators.runs import last_hours
from slicework.sources.sinks import has_snapshot, read_snapshot, swap_snapshot


def incremental_ingest(spark: SparkSession, root: str, schema, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Files that no earlier run has seen go through the transform to the target; the checkpoint remembers them."""
    stream = transform(spark.readStream.schema(schema).parquet(root))
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def live_metrics(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes", ts: str = "ts", keys: tuple[str, ...] = ("run",), value: str = "value") -> DataFrame:
    """Mean of a metric in each window of event time; late rows beyond the delay are left out."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = timed.groupBy(F.window(ts, window), *keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "mean", "n")


def keep_recent(stream: DataFrame, path: str, checkpoint: str, hours: float, keys: tuple[str, ...] = ("run",)) -> StreamingQuery:
    """The closed windows of ``live_metrics`` of the last hours before the newest one, as a snapshot at ``path``.

    Each batch's windows join those of the snapshot before, older ones go, and a new version is swapped in; read it with
    ``read_snapshot``. A batch that runs again after a failure replaces its own windows. What is rewritten is the hours
    times the keys, whatever the stream has held before.
    """

    def run(batch: DataFrame, _: int) -> None:
        both = batch
        if has_snapshot(batch.sparkSession, path):
            old = read_snapshot(batch.sparkSession, path)
            both = old.join(batch, ["start", *keys], "left_anti").unionByName(batch)
        elif batch.isEmpty():
            return
        swap_snapshot(last_hours(both, "start", hours), path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
