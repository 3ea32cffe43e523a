"""Queries over candidate lists and record selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import candidates as C
from grainmill.operators import relational as R
from grainmill.sources.tables import table as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
JOBS, TASKS = "recruitment_jobs_normalized", "label_studio_tasks_v2"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# lineitem as candidates: an order is the query, a supplier the code, the discount the score
_CAND = "WITH c AS (SELECT l_orderkey AS q, l_suppkey AS code, max(l_discount * 10) AS score FROM lineitem GROUP BY 1, 2)"


def _cand(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_discount").groupBy(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("code")).agg(F.max(F.col("l_discount") * 10).alias("score"))


@query("""WITH b AS (SELECT l_orderkey AS record, l_returnflag AS query, l_suppkey AS code, max(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3), tp AS (SELECT record, query, max(score) AS top FROM b GROUP BY 1, 2), m AS (SELECT *, max(top) OVER (PARTITION BY record) AS mx, CASE query WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 99 END AS pr FROM tp), ch AS (SELECT record, query FROM (SELECT *, row_number() OVER (PARTITION BY record ORDER BY pr, top DESC, query) AS rn FROM m WHERE top >= mx - 0.005) WHERE rn = 1)
SELECT record, query, code, score FROM (SELECT b.*, row_number() OVER (PARTITION BY record ORDER BY score DESC, code) AS rn FROM b JOIN ch USING (record, query)) WHERE rn <= 2""")
def multi_query_best(s, d):
    x = t(s, d, "lineitem", "l_orderkey", "l_returnflag", "l_suppkey", "l_discount").toDF("record", "query", "code", "s")
    return C.best_of_queries(x, "record", "code", "query", "s", {"R": 1, "A": 2}, k=2)


@query("""WITH e AS (SELECT l_orderkey AS q, l_suppkey AS code, l_discount AS score, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, code ORDER BY source, score DESC) AS r FROM e) WHERE r = 1)
SELECT q, code, score, source, slot FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY source, score DESC, code) AS slot FROM o) WHERE slot <= 5""")
def candidate_supplement(s, d):
    li = t(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_discount", "l_returnflag").toDF("q", "code", "s", "flag")
    out = t(s, d, "supplier", "s_suppkey").filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("code"))
    parts = [li.filter(F.col("flag") == "R"), li.filter(F.col("flag") == "A"), li.filter(~F.col("flag").isin("R", "A"))]
    x = C.supplement(parts, "q", "code", "s", 5, out)
    return x.select("q", "code", "score", "source", F.col("slot").cast("bigint").alias("slot"))


@query(_CAND + """, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, code) AS rn, lead(score) OVER (PARTITION BY q ORDER BY score DESC, code) AS nx, count(*) OVER (PARTITION BY q) AS n FROM c), z AS (SELECT q, score, round(score - coalesce(nx, 0), 6) AS margin, n FROM r WHERE rn = 1)
SELECT q, CASE WHEN score >= 0.97 AND margin >= 0.12 THEN 'accept' WHEN n = 1 OR score < 0.82 OR margin < 0.08 THEN 'escalate' ELSE 'cheap' END AS route FROM z""")
def routing_decision(s, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("q").orderBy(F.desc("score"), "code")
    x = _cand(s, d).withColumns({"rn": F.row_number().over(w), "nx": F.lead("score").over(w), "n": F.count("*").over(W.partitionBy("q"))}).filter("rn = 1")
    m = F.round(F.col("score") - F.coalesce("nx", F.lit(0.0)), 6)
    no = F.lit(False)
    return x.select("q", F.when(C.accept(F.col("score"), m), "accept").when(C.escalate(F.col("score"), m, F.col("n") == 1, no, no), "escalate").otherwise("cheap").alias("route"))


@query(_CAND + """, j AS (SELECT l_orderkey AS q, l_suppkey AS code, max(l_tax * 10) AS s FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2), b AS (SELECT q, code, row_number() OVER (PARTITION BY q ORDER BY score DESC, code) AS bb FROM c), k AS (SELECT q, code, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, code) AS jj FROM j),
x AS (SELECT b.q, b.code, bb, jj, s FROM b LEFT JOIN k ON b.q = k.q AND b.code = k.code), f AS (SELECT *, coalesce(max(CASE WHEN jj = 1 AND bb <> 1 THEN 1 END) OVER (PARTITION BY q) = 1 AND max(CASE WHEN jj = 1 AND (s < 0.5 OR s >= 0.85) THEN 1 END) OVER (PARTITION BY q) = 1, false) AS fell_back FROM x)
SELECT q, code, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN fell_back AND bb = 1 THEN 0 ELSE 1 END, jj ASC NULLS LAST, bb) AS place, fell_back FROM f""")
def rerank_merge(s, d):
    j = t(s, d, "lineitem").filter("l_quantity > 20").groupBy(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("code")).agg(F.max(F.col("l_tax") * 10).alias("score"))
    return C.rerank_merge(_cand(s, d), j, "q", "code").withColumn("place", F.col("place").cast("bigint"))


@query(_CAND + " SELECT q, code, CASE WHEN score <= 0 THEN 0.0 WHEN score >= 0.9 THEN round(least(0.6 + (score - 0.9) * 1.5, 0.85), 4) WHEN score >= 0.7 THEN round(0.35 + (score - 0.7) * 1.25, 4) ELSE round(score * 0.5, 4) END AS confidence FROM c")
def calibrated_confidence(s, d):
    return _cand(s, d).select("q", "code", C.calibrated(F.col("score"), F.lit("A")).alias("confidence"))


@query("""SELECT recruitment_record_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m'), company_name, job_title, work_city, md5(regexp_replace(regexp_replace(coalesce(job_description_raw, ''), '<[^>]+>', '', 'g'), '[\\t\\n\\f\\r ]+', '', 'g')), salary_raw, education_requirement_raw ORDER BY created_at, recruitment_record_id, updated_at) AS rn FROM recruitment_jobs_normalized) WHERE rn = 1""")
def monthly_dedup(s, d):
    """Six keys and the month, the earliest row kept; the text enters as a digest."""
    x = t(s, d, JOBS).withColumns({"m": F.date_format("created_at", "yyyy-MM"), "h": F.md5(F.regexp_replace(F.regexp_replace(F.coalesce("job_description_raw", F.lit("")), "<[^>]+>", ""), r"[\t\n\f\r ]+", ""))})
    x = x.select("m", "company_name", "job_title", "work_city", "h", "salary_raw", "education_requirement_raw", "created_at", "recruitment_record_id", "updated_at")
    return R.first_per_key(x, ["m", "company_name", "job_title", "work_city", "h", "salary_raw", "education_requirement_raw"], [F.col("created_at"), F.col("recruitment_record_id"), F.col("updated_at")]).select("recruitment_record_id", "created_at")


@query("""SELECT recruitment_record_id, substring(x, 1, 900) AS text FROM (SELECT recruitment_record_id, trim(job_description_raw, ' ') AS x, row_number() OVER (PARTITION BY substring(trim(job_description_raw, ' '), 1, 120) ORDER BY recruitment_record_id, updated_at) AS rn FROM recruitment_jobs_normalized WHERE length(trim(job_description_raw, ' ')) >= 20) WHERE rn = 1""")
def labelling_frame(s, d):
    """Texts of at least 20 characters, one of each beginning, cut to 900 characters for the annotator's form."""
    x = t(s, d, JOBS, "recruitment_record_id", "job_description_raw", "updated_at").withColumn("x", F.trim("job_description_raw")).filter(F.length("x") >= 20).withColumn("p", F.substring("x", 1, 120))
    return R.first_per_key(x, ["p"], [F.col("recruitment_record_id"), F.col("updated_at")]).select("recruitment_record_id", F.substring("x", 1, 900).alias("text"))


_CLASSES = {"技术": "软件|数据|网络|机器人|嵌入", "教育": "幼儿|教育|培训", "商务": "电商|营销|采购|客户", "生产": "纺织|食品|电池|维修"}


@query("SELECT cls, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(job_title, '{p}') THEN '{k}'" for k, p in _CLASSES.items()) + " ELSE '其他' END AS cls FROM recruitment_jobs_normalized) GROUP BY 1")
def first_keyword_class(s, d):
    out = None
    for k, p in _CLASSES.items():
        hit = F.col("job_title").rlike(p)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return t(s, d, JOBS, "job_title").select(out.otherwise("其他").alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT task_id, json(annotations_completed) AS j FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC) AS rn FROM label_studio_tasks_v2 WHERE json_valid(annotations_completed)) WHERE rn = 1), x AS (SELECT task_id, unnest(from_json(j, '["JSON"]')) AS e FROM a)
SELECT task_id, count(*) AS n_annotations, count(*) FILTER (WHERE coalesce(json_extract_string(e, '$.was_cancelled'), 'false') = 'false' AND json_extract_string(e, '$.created_at') IS NOT NULL AND json_array_length(e, '$.result') > 0) AS n_completed FROM x GROUP BY 1""")
def completed_annotations(s, d):
    x = t(s, d, TASKS, "task_id", "updated_at", "annotations_completed").filter(F.try_parse_json("annotations_completed").isNotNull())
    x = R.first_per_key(x, ["task_id"], [F.desc("updated_at")])
    kind = "array<struct<was_cancelled:boolean,created_at:string,result:array<struct<from_name:string>>>>"
    e = x.select("task_id", F.explode(F.from_json("annotations_completed", kind)).alias("e"))
    done = ~F.coalesce("e.was_cancelled", F.lit(False)) & F.col("e.created_at").isNotNull() & (F.size("e.result") > 0)
    return e.groupBy("task_id").agg(F.count("*").alias("n_annotations"), F.count(F.when(done, 1)).alias("n_completed"))


@query("""SELECT width_bucket_ AS bucket, count(*) AS n, round(sum(l_discount), 2) AS total FROM (SELECT l_discount, least(CAST(floor(l_discount * 10 / 0.2) AS BIGINT), 4) AS width_bucket_ FROM lineitem) GROUP BY 1""")
def disagreement_bins(s, d):
    """Bins of a score in 0..1, the last one closed: the value 1 is in it."""
    b = F.least(F.floor(F.col("l_discount") * 10 / 0.2).cast("bigint"), F.lit(4).cast("bigint"))
    return t(s, d, "lineitem", "l_discount").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 2).alias("total"))


@query()
def lenient_json(s, d):
    """Annotation payloads read leniently: how many tasks parse as they are, and how many after repair."""
    x = t(s, d, TASKS, "annotations_completed").filter("trim(annotations_completed) <> ''")
    x = x.select(F.try_parse_json("annotations_completed").isNotNull().alias("strict"), C.lenient_json(F.col("annotations_completed")).isNotNull().alias("lenient"))
    return x.groupBy("strict", "lenient").agg(F.count("*").alias("n"))
