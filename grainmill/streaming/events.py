"""Streams: windowed counts with late data, exact deduplication, sessions, and an idempotent merge of micro-batches.

Watermarks bound the state; rows later than the watermark are left out by Spark's rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators.relational import first_per_key
from grainmill.sources.shared import cut


def read_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, ``per_trigger`` files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, ts: str, keys: list[str], size: str = "1 hour", late: str = "1 day", value: str | None = None) -> DataFrame:
    """Counts (and the sum of ``value``) per window and keys; works on streams and on tables."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return e.groupBy(F.window("__ts", size), *keys).agg(*aggs).select(F.col("window.start").alias("window_start"), *keys, *[c for c in ("n", "total") if c == "n" or value])


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """key, session_start, session_end, n: runs of events less than ``gap`` apart."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return e.groupBy(F.session_window("__ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark's reach; of a table, the first row of each key by time, then by all columns."""
    if not events.isStreaming:
        return first_per_key(events, keys, [F.col(ts), *[F.col(c) for c in events.columns if c not in (*keys, ts)]])
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark(keys).drop("__ts")


def merge_batches(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], keys: list[str], newest: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the latest row of each key over table and batch.  A batch replayed after a failure changes nothing.

    With ``write`` to one folder the whole table is written a batch; :func:`merge_buckets` rewrites only the buckets that a batch touches.
    """

    def merge(batch: DataFrame, _: int) -> None:
        table = read()
        both = batch if table is None else table.unionByName(batch)
        write(first_per_key(both, keys, [F.col(newest).desc_nulls_last(), *[F.col(c) for c in both.columns if c not in (*keys, newest)]]))

    return merge


def merge_buckets(spark: SparkSession, folder: str, keys: list[str], newest: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Like :func:`merge_batches` for a table of ``folder`` parted by a hash of the keys: a batch reads and replaces the buckets of its own keys alone."""

    def merge(batch: DataFrame, _: int) -> None:
        b = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in b.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        try:
            old = spark.read.parquet(folder).filter(F.col("bucket").isin(touched)).select(*b.columns)
        except AnalysisException:  # nothing written yet
            old = b.limit(0)
        both = old.unionByName(b)
        new = cut(first_per_key(both, keys, [F.col(newest).desc_nulls_last(), *[F.col(c) for c in both.columns if c not in (*keys, newest)]]))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)

    return merge
