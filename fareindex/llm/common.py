"""Helpers shared by the operators: columns, words, written tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import apply_settings, work_dir

#: A word is a run of characters other than these separators.
SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """`doc_id` as long and `text`, with the named further columns; all other columns go, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.col(c).cast("string").alias(c) for c in more])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. `bytes.split` separates at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def bucket(key: Column, n: int) -> Column:
    """CRC-32 of the key as text, modulo n; null keys are bucket 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def smallest_hashes(key: Column, part: float) -> Column:
    """About this part of the keys, those of the smallest hashes."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 32)) < F.lit(int(part * (1 << 32)))


def commonest(df: DataFrame, key: str, count: str, most: int) -> Column:
    """A condition that about `most` keys of the largest counts meet: whole classes of like counts, 5 % apart, and of the last one the part
    that still fits. Only the sizes of the classes, some hundreds of numbers, reach the driver."""
    like = F.floor(F.log(F.col(count)) / math.log(1.05) + 1e-9)
    sizes = {r.like: r.n for r in df.groupBy(like.alias("like")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left = most
    for at in sorted(sizes, reverse=True):
        if sizes[at] > left:
            return (like > at) | ((like == at) & smallest_hashes(F.col(key), left / sizes[at]))
        left -= sizes[at]
    return F.lit(True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared work folder: cuts the lineage and gives later joins its true size."""
    spark = df.sparkSession
    path = work_dir(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], by: str = "text", chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in runs of about so many bytes of text, one row at least: bounds what Python holds at once."""
    for batch in batches:
        sizes = [0 if x is None else x for x in pa.compute.binary_length(batch.column(by)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            held += size
            if held >= chars:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < len(sizes):
            yield batch.slice(start)
