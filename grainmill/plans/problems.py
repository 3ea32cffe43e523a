"""Queries of the two general data problems: units (3) and instants (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import instants, units
from grainmill.sources.tables import table

JOBS = "recruitment_jobs_normalized"


def _pay(s: SparkSession, d: str):
    return table(s, d, JOBS, "recruitment_record_id", "source_table", "salary_raw", "job_description_raw"), table(s, d, "source_feeds"), table(s, d, "unit_factors")


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return units.found(*_pay(s, d))


def p3_units(s: SparkSession, d: str) -> DataFrame:
    """Rows by where their unit comes from, with the uncertain ones counted."""
    return units.common_units(*_pay(s, d)).groupBy("unit_from", "period", "currency", "scale").agg(F.count("*").alias("n_rows"), F.sum(F.col("uncertain").cast("bigint")).alias("n_uncertain"))


def _dates(s: SparkSession, d: str):
    return table(s, d, JOBS, "recruitment_record_id", "source_table", "publish_date", "created_at"), table(s, d, "source_feeds")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return instants.found(*_dates(s, d))


def p4_status(s: SparkSession, d: str) -> DataFrame:
    """Rows by how their local time met its zone: exact, ambiguous, skipped or none."""
    return instants.instants(*_dates(s, d)).groupBy("status").agg(F.count("*").alias("n_rows"))


QUERIES = {f.__name__: f for f in (p3_found, p3_units, p4_found, p4_status)}
