"""The update/delete event feed as a Structured Streaming job.

Landed event pages (JSON Lines text files, one page per line) are read as a
file stream, parsed and validated with the batch operators, and split into
the 'updated' workout rows (C13) and the 'deleted' events (C14). Each
micro-batch is written with ``foreachBatch`` under a batch-id folder in
overwrite mode, so a replayed batch after a failure rewrites the same files
instead of duplicating them (exactly-once output with the stream checkpoint
in the session's shared checkpoint folder). ``availableNow`` processes what
has landed and stops, which is how a scheduled run uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from liftlake.operators import flatten, validate
from liftlake.sources import landing


def read_event_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    raw = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
           .load(landing_dir).withColumnRenamed("value", "body"))
    return landing.parse_pages(raw, "events")


def start_event_feed(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint_dir: str, run_ts: Column,
                     available_now: bool = True):
    """Start the feed; returns the StreamingQuery. Output tables:
    ``out_dir/updated``, ``out_dir/deleted`` and ``out_dir/rejects`` (Parquet,
    one folder per micro-batch id). A batch is parsed once for the three."""
    items = read_event_stream(spark, landing_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        valid, rejects = validate.validate_events(batch)
        tables = {"updated": flatten.updated_events_flat(valid, run_ts), "deleted": flatten.deleted_events(batch), "rejects": rejects}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch_id}")
        batch.unpersist()

    w = items.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def run_event_feed(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint_dir: str,
                   run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Process everything landed so far and return (updated, deleted)."""
    q = start_event_feed(spark, landing_dir, out_dir, checkpoint_dir, run_ts, available_now=True)
    q.awaitTermination()
    upd = spark.read.parquet(f"{out_dir}/updated").drop("batch_id")
    dele = spark.read.parquet(f"{out_dir}/deleted").drop("batch_id")
    return upd, dele


def land_event_pages(spark: SparkSession, sf_dir: str, landing_dir: str) -> None:
    """Land the event pages derived from the ``events`` table as text files,
    as many as the pages have partitions."""
    landing.write_pages(landing.landed_event_pages(spark, sf_dir), landing_dir)
