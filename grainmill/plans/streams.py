"""Queries over streaming operators run on tables, over merges of found terms, and over labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import candidates as C
from grainmill.operators import dictionaries as D
from grainmill.operators import skills
from grainmill.sources import files
from grainmill.sources.shared import cut
from grainmill.sources.tables import table as t
from grainmill.streaming import events as E

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
JOBS = "recruitment_jobs_normalized"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def events_tumbling(s, d):
    x = E.tumbling(t(s, d, "events"), "ts", ["event_type"], value="value")
    return x.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 3)})


@query("SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2")
def events_deduplicated(s, d):
    return E.deduplicated(t(s, d, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type", "ts")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id, event_type, value, props) AS rn FROM events) WHERE rn = 1")
def merged_batches(s, d):
    """The latest row of each user after three micro-batches, the second one replayed."""
    state: dict = {}
    merge = E.merge_batches(lambda: state.get("t"), lambda df: state.update(t=cut(df)), ["user_id"], "ts")
    e = t(s, d, "events")
    for i, part in enumerate((0, 1, 1, 2)):
        merge(e.filter(F.col("event_id") % 3 == part), i)
    return state["t"].select("user_id", "event_id", "value")


@query(f"SELECT month, count(*) AS n FROM (SELECT coalesce(strftime(coalesce(CASE WHEN regexp_matches(x, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}$') THEN try_strptime(x, '%Y-%m-%d %H:%M:%S') END, CASE WHEN regexp_matches(x, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_strptime(x, '%Y-%m-%d') END), '%Y-%m'), '') AS month FROM (SELECT regexp_replace(coalesce(publish_date, ''), '^[\\s　 ]+|[\\s　 ]+$', '', 'g') AS x FROM {JOBS})) GROUP BY 1")
def publish_months(s, d):
    m = X.month(F.col("publish_date"), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return t(s, d, JOBS, "publish_date").groupBy(m.alias("month")).agg(F.count("*").alias("n"))


@query(f"SELECT source_table, source_platform, count(*) AS n FROM (SELECT source_table, CASE WHEN contains(lower(source_table), '51job') THEN '51job' WHEN contains(lower(source_table), 'liepin') THEN 'Liepin' WHEN contains(lower(source_table), 'zhilian') THEN 'Zhilian' ELSE 'unknown' END AS source_platform FROM {JOBS}) GROUP BY 1, 2")
def platform_names(s, d):
    return files.with_platform(t(s, d, JOBS, "source_table")).groupBy("source_table", "source_platform").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS record, l_suppkey AS code, round(0.6 * coalesce(max(l_discount) FILTER (WHERE l_returnflag = 'N'), 0) + 0.4 * coalesce(max(l_discount) FILTER (WHERE l_returnflag <> 'N'), 0) + max(CASE WHEN l_linestatus = 'O' THEN 0.05 ELSE 0.0 END), 6) AS score FROM lineitem GROUP BY 1, 2")
def definition_task_fusion(s, d):
    x = t(s, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("code"), F.when(F.col("l_returnflag") == "N", "definition").otherwise("task").alias("kind"), F.col("l_discount").alias("s"), F.when(F.col("l_linestatus") == "O", 0.05).otherwise(0.0).alias("b"))
    return C.fused_max(x, "record", "code", "kind", "s", {"definition": 0.6, "task": 0.4}, F.col("b")).withColumn("score", F.round("score", 6))


_WORD = "SELECT p_partkey AS id, unnest(list_distinct(string_split(p_name, ' '))) AS name FROM part"


@query(f"WITH f AS ({_WORD}), v AS (SELECT id, name, id % 3 = 0 AS ok, 'd' || id % 2 AS dim FROM f WHERE id % 2 = 0) SELECT f.id, f.name, CASE WHEN ok IS NULL THEN 'soft' ELSE dim END AS dimension, CASE WHEN ok IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN ok IS NULL THEN 'unconfirmed' ELSE 'confirmed' END AS source FROM f LEFT JOIN v ON f.id = v.id AND f.name = v.name WHERE ok IS NULL OR ok")
def validation_merge(s, d):
    f = _words(s, d).withColumns({"dimension": F.lit("soft"), "confidence": F.lit(0.85)})
    v = _words(s, d).filter("id % 2 = 0").withColumns({"is_valid": F.col("id") % 3 == 0, "dimension": F.concat(F.lit("d"), (F.col("id") % 2).cast("string"))})
    return C.validated(f, v, "id", "name")


def _words(s, d):
    return t(s, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("name"))


@query(f"WITH f AS ({_WORD}), h AS (SELECT id, upper(name) AS name FROM f WHERE length(name) = 4) SELECT id, name, 'hard' AS kind FROM h UNION ALL SELECT id, name, 'soft' FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = f.id AND lower(h.name) = lower(f.name))")
def hard_before_soft(s, d):
    w = _words(s, d)
    return C.hard_over_soft(w.filter("length(name) = 4").withColumn("name", F.upper("name")), w, "id", "name")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w, i: CASE WHEN w[1] = 'b' THEN 'B-X' WHEN w[1] = 'r' THEN 'B-Y' ELSE 'O' END), ' ') AS tags, true AS same FROM part")
def label_round_trip(s, d):
    """BIO labels of words, and whether reading them gives the spans back."""
    p = t(s, d, "part", "p_partkey", "p_name").withColumn("w", F.split("p_name", " "))
    spans = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("start"), (i + 1).alias("end"), F.when(w.startswith("b"), "X").when(w.startswith("r"), "Y").alias("label"))), lambda x: x["label"].isNotNull())
    p = p.withColumn("spans", spans).withColumn("bio", skills.bio_tags(F.col("w"), F.col("spans")))
    return p.select("p_partkey", F.array_join("bio", " ").alias("tags"), (D.decoded(F.col("w"), F.col("bio")) == F.col("spans")).alias("same"))
