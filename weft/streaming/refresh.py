"""Keeping the tables of a graph fresh from a folder that files arrive in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.incremental import changed_records
from weft.operators.snapshots import debounced

ARRIVALS = "path string, project string, content_hash string, indexed_at timestamp"


def arrivals(spark: SparkSession, folder: str, schema: str = ARRIVALS, files_per_batch: int = 100) -> DataFrame:
    """A stream of file versions, from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def refresh(stream: DataFrame, checkpoint: str, ledger: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], interval: str | None = "3 seconds") -> StreamingQuery:
    """Give ``handle`` the records of each batch that the ledger lacks, at most once for each key and version.

    The batch number is passed on, so that a handler that writes under it is idempotent: after a failure the batch is
    given again, and what it wrote before is overwritten or is in the ledger. Without an interval what is there is
    processed and the query ends."""

    def batch(rows: DataFrame, number: int) -> None:
        source = rows.select(F.col("path").alias("key"), F.col("content_hash").alias("version"), "project", F.col("indexed_at").alias("seen_at"))
        handle(changed_records(source, ledger()).drop("via"), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def settled(stream: DataFrame, group: list[str], ts: str, gap: str = "1.5 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of events that have come to rest, as a stream; an event later than ``late`` is not waited for."""
    return debounced(stream.withWatermark(ts, late), group, ts, gap)
