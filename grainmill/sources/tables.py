"""Reading the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns`` only these, in this order."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def with_missing_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Project to ``schema`` (name -> type); a column that ``df`` lacks becomes NULL of that type."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`").cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def first_existing(df: DataFrame, names: list[str]) -> str | None:
    """The first of ``names`` that is a column of ``df``."""
    return next((n for n in names if n in df.columns), None)
