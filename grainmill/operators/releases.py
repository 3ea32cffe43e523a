"""Tables with a history: releases of resources, replaced tables, audits, and what to do when a table is empty.

Every function maps frames to the frame that the table holds afterwards; writers at the end do the writing.  NULL keys are keys of their own; empty
input changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators.relational import first_per_key


def current(releases: DataFrame, release: str = "release_id", flag: str = "is_current") -> DataFrame:
    """The one current release as a frame of one row and column; a run fails where none or several are marked."""
    x = releases.filter(F.coalesce(flag, F.lit(False))).agg(F.countDistinct(release).alias("n"), F.max(release).alias(release))
    return x.select(F.when(F.col("n") == 1, F.col(release)).otherwise(F.raise_error(F.concat(F.lit("current releases: "), F.col("n").cast("string")))).alias(release))


def bound(resource: DataFrame, releases: DataFrame, release: str = "release_id", flag: str = "is_current") -> DataFrame:
    """The rows of ``resource`` that belong to the current release."""
    return resource.filter(F.col(release) == current(releases, release, flag).scalar())


def stamped(releases: DataFrame, new: DataFrame, release: str = "release_id", flag: str = "is_current") -> DataFrame:
    """Release rows after ``new`` (one row) came in: it replaces its like, and it alone is current."""
    key = new.select(release)
    return releases.join(key, release, "left_anti").withColumn(flag, F.lit(False)).unionByName(new.withColumn(flag, F.lit(True)))


def replaced(resource: DataFrame, new: DataFrame, release: str = "release_id") -> DataFrame:
    """``resource`` with all rows of the releases in ``new`` replaced by those of ``new``."""
    return resource.join(new.select(release).distinct(), release, "left_anti").select(*resource.columns).unionByName(new.select(*resource.columns))


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], stamp: str, at: Column) -> DataFrame:
    """Rows after an upsert by key: incoming ones win and carry ``at`` in ``stamp``; of equal incoming keys the first by all columns."""
    cols = existing.columns
    new = first_per_key(incoming.select(*[c for c in cols if c != stamp]).withColumn(stamp, at).select(*cols), keys, [F.col(c) for c in cols if c not in keys])
    return existing.join(new.select(*keys), keys, "left_anti").select(*cols).unionByName(new)


def filled_if_empty(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` where it has rows, else ``incoming`` with each key once."""
    if existing.limit(1).count():
        return existing
    return first_per_key(incoming.select(*existing.columns), keys, [F.col(c) for c in existing.columns if c not in keys])


def back_propagated(rows: DataFrame, audit: DataFrame, key: str, target: str, status: str, accepted: list[str]) -> DataFrame:
    """``rows`` with ``target`` set from the audit row of the same key, where its status is accepted and it names something."""
    a = audit.filter(F.col(status).isin(accepted) & (F.coalesce(target, F.lit("")) != "")).groupBy(key).agg(F.max(target).alias("__target"))
    return rows.join(a, key, "left").withColumn(target, F.coalesce("__target", target)).drop("__target").select(*rows.columns)


def with_provenance(df: DataFrame, sources: list[str], name: str = "provenance") -> DataFrame:
    """Add a map from each source that knew the row (its flag from_<source>) to 'merged'."""
    pairs = F.array_compact(F.array(*[F.when(F.col(f"from_{s}"), F.struct(F.lit(s).alias("k"), F.lit("merged").alias("v"))) for s in sources]))
    return df.withColumn(name, F.map_from_entries(pairs))


def views(spark: SparkSession, table: DataFrame, conditions: dict[str, str]) -> None:
    """A temporary view a condition over one unified table."""
    for name, condition in conditions.items():
        table.filter(condition).createOrReplaceTempView(name)


def save_table(df: DataFrame, name: str, append: bool = False) -> None:
    """Create or replace a table, or append to it (created where it is missing)."""
    df.write.mode("append" if append else "overwrite").saveAsTable(name)


def save_tables(tables: dict[str, DataFrame], database: str | None = None) -> None:
    """Drop and create several tables."""
    for name, df in tables.items():
        save_table(df, f"{database}.{name}" if database else name)


def snapshot(resources: dict[str, DataFrame], folder: str) -> None:
    """Each resource as JSON lines under its name: the export of a release."""
    for name, df in resources.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
