"""Continuous form of the observation sink.

New raw files are cleaned row by row and each micro-batch goes through the same keyed append as a batch run. The stored
table itself is the memory of what has been seen, so a repeat is removed however late it comes, a replayed batch adds
nothing, and no late row is lost. A watermark may be given to drop repeats earlier, in the state store; rows older than
the watermark are then dropped by Spark, so it must cover the longest delay of the feed.

A ledger beside the table has two rows for each micro-batch, written before and after its append. A batch with the second
row is not touched again; one with the first only was interrupted: its rows are in the table under its number, and the
replay adds the missing ones and counts both.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cleaning import DUPLICATE_KEY, accepted, assess, normalize_tidy
from ..schemas import RAW_QUOTES, STORED_FARES
from ..sources.stores import persist_observations, read_table

HELD = (*[c.split()[0] for c in STORED_FARES.split(", ")], "ingest_seq")  # what the append needs of a row
LEDGER_SCHEMA = "stream string, batch_id bigint, state string, rows bigint, rejected bigint, added bigint, noted_at timestamp"


def raw_stream(spark: SparkSession, path: str, schema: str = RAW_QUOTES, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def cleaned_stream(raw: DataFrame, watermark: str | None = None) -> DataFrame:
    """Accepted, normalized quotes; with a watermark each duplicate key once within it."""
    rows = accepted(raw)
    if watermark is None:
        return rows
    return rows.withWatermark("observation_timestamp", watermark).dropDuplicatesWithinWatermark(list(DUPLICATE_KEY))


def assessed_stream(raw: DataFrame) -> DataFrame:
    """All quotes, normalized, with ``reject_reason`` for those that are not accepted."""
    return normalize_tidy(assess(raw)).drop("normalize_error")


def ledger_path(table_path: str) -> str:
    return f"{table_path.rstrip('/')}_batches"


def note(spark: SparkSession, table_path: str, stream: str, batch_id: int, state: str, rows=None, rejected=None, added=None) -> None:
    """Append one row to the ledger."""
    figures = [F.lit(v).cast("bigint").alias(n) for n, v in (("rows", rows), ("rejected", rejected), ("added", added))]
    spark.range(1, numPartitions=1).select(
        F.lit(stream).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(state).alias("state"), *figures,
        F.current_timestamp().alias("noted_at")).write.mode("append").parquet(ledger_path(table_path))


def to_hold(batch: DataFrame) -> DataFrame:
    """The columns of a batch that its append needs; of rejected rows the reason alone."""
    names = [c for c in HELD if c in batch.columns]
    if "reject_reason" not in batch.columns:
        return batch.select(*names)
    fine = F.col("reject_reason").isNull()
    return batch.select(*[F.when(fine, F.col(c)).alias(c) for c in names], "reject_reason")


def append_batch(batch: DataFrame, batch_id: int, table_path: str, stream: str) -> None:
    """Store one micro-batch of assessed or accepted rows exactly once, and its figures in the ledger.

    The rows are computed once and held: their figures, their dates and their comparison with the table come from the same copy.
    """
    spark = batch.sparkSession
    known = read_table(spark, ledger_path(table_path), LEDGER_SCHEMA).filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id))
    states = {r[0] for r in known.select("state").collect()}  # two at most
    if "committed" in states:
        return
    tag, earlier = f"{stream}#{batch_id}", 0
    if states:
        stored = read_table(spark, table_path, STORED_FARES + ", ingest_batch string")
        earlier = stored.filter(F.col("ingest_batch") == tag).count()
    else:
        note(spark, table_path, stream, batch_id, "opened")
    held = to_hold(batch).persist(StorageLevel.DISK_ONLY)
    try:
        lost = F.col("reject_reason").isNotNull() if "reject_reason" in batch.columns else F.lit(None).cast("boolean")
        rows, rejected = held.agg(F.count(F.lit(1)), F.sum(lost.cast("bigint"))).first()
        fine = held.filter(F.col("reject_reason").isNull()).drop("reject_reason") if "reject_reason" in batch.columns else held
        added = persist_observations(fine, table_path, marked=False, held=True, tag=tag)
    finally:
        held.unpersist()
    note(spark, table_path, stream, batch_id, "committed", rows, rejected, earlier + added)


def ledger(spark: SparkSession, table_path: str) -> DataFrame:
    """Finished micro-batches with the rows they brought, rejected (null with a watermark, where rejects are dropped before) and added."""
    return read_table(spark, ledger_path(table_path), LEDGER_SCHEMA).filter("state = 'committed'").drop("state")


def start_ingest(
    raw: DataFrame, table_path: str, checkpoint: str, watermark: str | None = None, available_now: bool = True, stream: str | None = None,
):
    """Start the ingest; with ``available_now`` it stops after the files that are there. ``stream`` names the feed in the ledger; the batches
    of a checkpoint are numbered by Spark, so it is the checkpoint's path unless given."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, table_path, checkpoint if stream is None else stream)

    rows = assessed_stream(raw) if watermark is None else cleaned_stream(raw, watermark)
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_ingest(raw: DataFrame, table_path: str, checkpoint: str, watermark: str | None = None, stream: str | None = None) -> None:
    """Ingest what is there and return."""
    query = start_ingest(raw, table_path, checkpoint, watermark, stream=stream)
    try:
        query.awaitTermination()
    finally:
        query.stop()
