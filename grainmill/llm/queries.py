"""Queries of this subpackage: name -> (spark, folder) -> DataFrame, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import canonical, consensus, encode, names, nearcopies, overlap, pack, pieces
from grainmill.sources.shared import cut
from grainmill.sources.tables import table

JOBS = "recruitment_jobs_normalized"


def _splits(s: SparkSession, d: str):
    return [table(s, d, n, "row_id", "text", "source") for n in ("train_set", "val_set", "test_set")]


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return overlap.found(*_splits(s, d))


def p1_report(s: SparkSession, d: str) -> DataFrame:
    return overlap.report(p1_records(s, d))


def p1_records(s: SparkSession, d: str) -> DataFrame:
    """Each evaluation record with the training texts it overlaps, counted, and its coverage."""
    return overlap.records(*_splits(s, d))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return consensus.found(table(s, d, "label_studio_tasks_v2", "task_id", "updated_at", "annotations_completed"))


def p2_reliability(s: SparkSession, d: str) -> DataFrame:
    v = cut(consensus.votes(table(s, d, "label_studio_tasks_v2", "task_id", "updated_at", "annotations_completed")))
    return consensus.reliability(v, consensus.fit(v)[0])


def p2_agreement(s: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(consensus.votes(table(s, d, "label_studio_tasks_v2", "task_id", "updated_at", "annotations_completed")))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(s, d, JOBS, "recruitment_record_id", "job_title"), table(s, d, "occ_dict_unified"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return nearcopies.found(table(s, d, JOBS, "recruitment_record_id", "job_description_raw"))


def p6_groups(s: SparkSession, d: str) -> DataFrame:
    """record_id, class_id, n_links (other classes with nearly the same wording) and group_id of each record long enough."""
    return nearcopies.groups(table(s, d, JOBS, "recruitment_record_id", "job_description_raw"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return names.found(table(s, d, JOBS, "company_name", "work_city"))


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(s, d, "documents", "doc_id", "text"))


def p9_containers(s: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(s, d, "documents", "doc_id", "text"))


def p10_pieces(s: SparkSession, d: str) -> DataFrame:
    return pieces.split(table(s, d, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p1_records, p2_found, p2_reliability, p2_agreement, p5_found, p6_found, p6_groups, p7_found, p8_ids, p9_containers, p10_pieces)
}

#: The operators above are checked by brute force, exact round trips and planted cases in tests/llm; SQL states only what is plain counting.
ORACLE: dict[str, str] = {}
