"""Sinks and a bounded runner: results land in files, never in driver memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from glossweave.session import scratch_path


#: When batches run: all that is there and then stop, or a dictionary such as
#: ``{"processingTime": "10 seconds"}`` for a query that goes on.
AVAILABLE_NOW = {"availableNow": True}


def start_append(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Append finished rows to Parquet (exactly once through the sink's log)."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_updates(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Write each batch's changed rows to its own folder; a repeated batch overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_routed(
    stream: DataFrame, path: str, checkpoint: str, target: str = "target", trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """One folder per target and batch, written in one pass; a repeated batch overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(target, "batch_id")
            .parquet(path)
        )

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_available(start, stream: DataFrame, name: str, **options) -> str:
    """Process all available input and return the folder the results are in."""
    root = scratch_path(stream.sparkSession, name)
    query = start(stream, f"{root}/out", f"{root}/checkpoint", **options)
    query.awaitTermination()
    return f"{root}/out"


def append_result(stream: DataFrame, name: str) -> DataFrame:
    """Rows an append-mode stream emits for the available input."""
    path = run_available(start_append, stream, name)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def update_result(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The last version of each key that an update-mode stream wrote."""
    path = run_available(start_updates, stream, name)
    rows = stream.sparkSession.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("_m"))
        .select(*keys, *[f"_m.{c}" for c in rest])
    )


def routed_result(stream: DataFrame, name: str, target: str = "target") -> DataFrame:
    """All rows of all targets."""
    path = run_available(start_routed, stream, name, target=target)
    return stream.sparkSession.read.parquet(path).drop("batch_id")
