"""Queries over releases, upserts, keyed joins and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.functions import text as X
from grainmill.operators import agreement as A
from grainmill.operators import relational as R
from grainmill.operators import releases as Z
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


@query("SELECT o_orderkey, rn AS row_number, CAST((rn - 1) // 1000 + 1 AS BIGINT) AS chunk FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)")
def numbered_chunks(s, d):
    x = R.row_numbers(t(s, d, "orders", "o_orderkey"), ["o_orderkey"])
    return x.select("o_orderkey", "row_number", R.chunk_of(F.col("row_number"), 1000).alias("chunk"))


_DOCV = "SELECT doc_id, recruitment_record_id, text, collected_at, 'v' || (n_chars % 23) AS version FROM documents WHERE recruitment_record_id IS NOT NULL"


def _versions(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "documents", "doc_id", "recruitment_record_id", "text", "collected_at", "n_chars").filter("recruitment_record_id IS NOT NULL")
    return x.select("doc_id", "recruitment_record_id", "text", "collected_at", F.concat(F.lit("v"), (F.col("n_chars") % 23).cast("string")).alias("version"))


_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recruitment_record_id ORDER BY collected_at DESC NULLS LAST, try_cast(regexp_replace(coalesce(version, ''), '\\D', '', 'g') AS BIGINT) DESC NULLS LAST, version DESC NULLS LAST, doc_id ASC NULLS FIRST) AS rn FROM ({_DOCV})) WHERE rn = 1"


@query(f"SELECT recruitment_record_id, doc_id, version FROM ({_LATEST})")
def latest_versions(s, d):
    return R.latest(_versions(s, d), ["recruitment_record_id"], "collected_at", "version").select("recruitment_record_id", "doc_id", "version")


@query(f"SELECT j.recruitment_record_id, j.source_row_number, l.doc_id FROM {JOBS} j JOIN ({_LATEST}) l USING (recruitment_record_id) WHERE regexp_matches(l.text, '[。；;]\\s*(?:岗位职责|任职要求|岗位要求)[:：]|福利|补贴') AND coalesce(j.job_description_raw, '') <> ''")
def risk_with_latest(s, d):
    """Source rows joined to their latest document, kept where its text matches a risk pattern."""
    last = R.latest(_versions(s, d), ["recruitment_record_id"], "collected_at", "version").filter(F.col("text").rlike(r"[。；;]\s*(?:岗位职责|任职要求|岗位要求)[:：]|福利|补贴"))
    j = t(s, d, JOBS, "recruitment_record_id", "source_row_number", "job_description_raw").filter(F.coalesce("job_description_raw", F.lit("")) != "")
    return j.join(last, "recruitment_record_id").select("recruitment_record_id", "source_row_number", "doc_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def release_rows(s, d):
    """Rows bound to the current release: regions as releases, nations as their resource."""
    rel = t(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), (F.col("r_name") == "ASIA").alias("is_current"))
    return Z.bound(t(s, d, "nation"), rel, "n_regionkey").select("n_nationkey", "n_name")


@query("SELECT r_regionkey AS release_id, r_name AS label, r_name = 'EUROPE' AS is_current FROM region")
def release_stamped(s, d):
    rel = t(s, d, "region").select(F.col("r_regionkey").alias("release_id"), F.col("r_name").alias("label"), (F.col("r_name") == "ASIA").alias("is_current"))
    return Z.stamped(rel, rel.filter("label = 'EUROPE'").drop("is_current"))


@query("SELECT n_regionkey AS release_id, n_name AS term, 'old' AS state FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT r_regionkey, r_name, 'new' FROM region WHERE r_regionkey = 2")
def release_replaced(s, d):
    old = t(s, d, "nation").select(F.col("n_regionkey").alias("release_id"), F.col("n_name").alias("term"), F.lit("old").alias("state"))
    new = t(s, d, "region").filter("r_regionkey = 2").select(F.col("r_regionkey").alias("release_id"), F.col("r_name").alias("term"), F.lit("new").alias("state"))
    return Z.replaced(old, new)


@query("WITH i AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0) SELECT s_suppkey AS k, s_name AS v, 'before' AS parsed_at FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM i) UNION ALL SELECT k, v, 'now' FROM i")
def upsert_parsed(s, d):
    old = t(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), F.lit("before").alias("parsed_at"))
    new = t(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return Z.upsert_latest(old, new, ["k"], "parsed_at", F.lit("now"))


@query("SELECT min(c_custkey) AS id, c_nationkey AS k FROM customer GROUP BY 2")
def fill_when_empty(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"))
    return Z.filled_if_empty(c.filter("false"), c, ["k"])


@query(f"WITH a AS (SELECT task_id, max(nullif(recruitment_record_id, '')) AS given, max(job_title) AS title FROM {TASKS} GROUP BY 1) SELECT task_id, CASE WHEN given IS NULL THEN coalesce('t-' || title, '') ELSE given END AS recruitment_record_id FROM a")
def audit_back_propagation(s, d):
    """Keys set from an audit table where it resolved them."""
    x = t(s, d, TASKS, "task_id", "recruitment_record_id", "job_title").groupBy("task_id").agg(F.max(F.nullif("recruitment_record_id", F.lit(""))).alias("g"), F.max("job_title").alias("title"))
    rows = x.select("task_id", F.coalesce("g", F.lit("")).alias("recruitment_record_id"))
    audit = x.select("task_id", F.concat(F.lit("t-"), "title").alias("recruitment_record_id"), F.when(F.col("g").isNull(), "unique").otherwise("kept").alias("status"))
    return Z.back_propagated(rows, audit, "task_id", "recruitment_record_id", "status", ["unique"])


@query("SELECT 'leaf' AS kind, count(*) AS n FROM occ_dict_unified WHERE is_terminal UNION ALL SELECT 'class', count(*) FROM occ_dict_unified WHERE NOT is_terminal")
def dictionary_views(s, d):
    Z.views(s, t(s, d, "occ_dict_unified"), {"leaf_nodes": "is_terminal", "class_nodes": "NOT is_terminal"})
    return s.sql("SELECT 'leaf' AS kind, count(*) AS n FROM leaf_nodes UNION ALL SELECT 'class', count(*) FROM class_nodes")


@query("""SELECT k, v, coalesce(a, false) AS from_region, coalesce(b, false) AS from_nation, concat_ws(',', CASE WHEN b THEN 'nation' END, CASE WHEN a THEN 'region' END) AS sources FROM (SELECT coalesce(s.k, r.k, n.k) AS k, coalesce(n.v, r.v, s.v) AS v, r.k IS NOT NULL AS a, n.k IS NOT NULL AS b
FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier) s FULL JOIN (SELECT r_regionkey AS k, r_name AS v FROM region) r ON s.k = r.k FULL JOIN (SELECT n_nationkey AS k, n_name AS v FROM nation) n ON coalesce(s.k, r.k) = n.k)""")
def provenance_merge(s, d):
    kv = lambda n, k, v: t(s, d, n).select(F.col(k).cast("bigint").alias("k"), F.col(v).alias("v"))
    x = R.enriching_merge(kv("supplier", "s_suppkey", "s_name"), [("region", kv("region", "r_regionkey", "r_name")), ("nation", kv("nation", "n_nationkey", "n_name"))], "k", ["v"])
    x = x.withColumns({"from_region": F.coalesce("from_region", F.lit(False)), "from_nation": F.coalesce("from_nation", F.lit(False))})
    return Z.with_provenance(x, ["region", "nation"]).select("k", "v", "from_region", "from_nation", F.array_join(F.array_sort(F.map_keys("provenance")), ",").alias("sources"))


@query("SELECT event_id, CAST(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), user_id) AS BIGINT) AS k, coalesce(json_extract_string(props, '$.label'), event_type) AS label FROM events")
def payload_merge(s, d):
    x = t(s, d, "events", "event_id", "user_id", "event_type", "props")
    return x.select("event_id", R.filled(F.col("props"), "$.k", F.col("user_id"), "bigint").alias("k"), R.filled(F.col("props"), "$.label", F.col("event_type")).alias("label"))


@query("SELECT side, count(*) AS n, round(sum(l_discount), 2) AS total FROM (SELECT CASE WHEN l_discount >= 0.05 THEN 'matched' ELSE 'pending' END AS side, l_discount FROM lineitem) GROUP BY 1")
def threshold_split(s, d):
    yes, no = R.split_at(t(s, d, "lineitem", "l_discount"), "l_discount", 0.05)
    x = yes.withColumn("side", F.lit("matched")).unionByName(no.withColumn("side", F.lit("pending")))
    return x.groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 2).alias("total"))


@query(f"SELECT count(*) AS n_rows, count(DISTINCT recruitment_record_id) AS n_records FROM {JOBS} WHERE job_title IS NOT NULL AND company_name IS NOT NULL AND salary_raw IS NOT NULL AND publish_date IS NOT NULL")
def complete_rows(s, d):
    return R.complete(t(s, d, JOBS), ["job_title", "company_name", "salary_raw", "publish_date"]).agg(F.count("*").alias("n_rows"), F.countDistinct("recruitment_record_id").alias("n_records"))


@query("SELECT code, '''' || code AS protected, code AS back FROM occ_dict_unified WHERE code IS NOT NULL AND trim(code) <> ''")
def spreadsheet_text(s, d):
    """Codes kept from turning into dates in a spreadsheet, and read back."""
    x = t(s, d, "occ_dict_unified", "code").filter("code IS NOT NULL AND trim(code) <> ''").withColumn("protected", X.protected(F.col("code")))
    return x.select("code", "protected", X.unprotected(F.col("protected")).alias("back"))


@query("SELECT recruitment_record_id, source_table, source_row_number, coalesce(salary_raw, '') <> '' AS has_salary, coalesce(education_requirement_raw, '') <> '' AS has_education, coalesce(publish_date, '') <> '' AS has_date FROM recruitment_jobs_normalized")
def coverage_flags(s, d):
    has = lambda c: (F.coalesce(c, F.lit("")) != "")
    return t(s, d, JOBS).select("recruitment_record_id", "source_table", "source_row_number", has("salary_raw").alias("has_salary"), has("education_requirement_raw").alias("has_education"), has("publish_date").alias("has_date"))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, o.o_orderstatus, o.o_orderpriority FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R'")
def facts_with_metadata(s, d):
    f = t(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").filter("l_returnflag = 'R'").drop("l_returnflag")
    return f.join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority"), "l_orderkey", "left")


@query(f"SELECT m.recruitment_record_id, m.job_title, j.job_title AS job_title_raw, j.work_city FROM (SELECT DISTINCT recruitment_record_id, job_title FROM {TASKS} WHERE recruitment_record_id <> '') m LEFT JOIN (SELECT recruitment_record_id, max(job_title) AS job_title, max(work_city) AS work_city FROM {JOBS} GROUP BY 1) j USING (recruitment_record_id)")
def manifest_with_raw(s, d):
    m = t(s, d, TASKS, "recruitment_record_id", "job_title").filter("recruitment_record_id <> ''").distinct()
    j = t(s, d, JOBS).groupBy("recruitment_record_id").agg(F.max("job_title").alias("job_title"), F.max("work_city").alias("work_city"))
    return R.suffixed_join(m, j, ["recruitment_record_id"], "_raw")


@query("SELECT p_partkey, p_name, p_size * 2 AS doubled, upper(p_type) AS kind FROM part")
def keyed_concat(s, d):
    """Two results side by side, matched by key instead of by position."""
    p = t(s, d, "part")
    return p.select("p_partkey", "p_name").join(p.select("p_partkey", (F.col("p_size") * 2).alias("doubled")), "p_partkey").join(p.select("p_partkey", F.upper("p_type").alias("kind")), "p_partkey")


_VOTES = f"""WITH l AS (SELECT task_id, annotations_completed AS j FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC) AS rn FROM {TASKS} WHERE json_valid(annotations_completed)) WHERE rn = 1),
m AS (SELECT task_id, cand_a_code AS model FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC) AS rn FROM {TASKS}) WHERE rn = 1 AND cand_a_source = 'dense'), h AS (SELECT task_id, json_array_length(j) AS n FROM l WHERE json_array_length(j) > 0)"""


@query(_VOTES + " SELECT h.task_id, h.n, m.model FROM h JOIN m USING (task_id)")
def human_with_model(s, d):
    """Tasks that people answered and that the dense model labelled too."""
    x = t(s, d, TASKS)
    last = lambda y: R.first_per_key(y, ["task_id"], [F.desc("updated_at")])
    h = last(x.filter(F.try_parse_json("annotations_completed").isNotNull())).select("task_id", F.json_array_length("annotations_completed").cast("bigint").alias("n")).filter("n > 0")
    m = last(x).filter("cand_a_source = 'dense'").select("task_id", F.col("cand_a_code").alias("model"))
    return h.join(m, "task_id")


@query("""WITH x AS (SELECT l_orderkey AS item, l_linenumber AS place, l_returnflag = 'R' AS ok, l_linestatus = 'F' AS hit FROM lineitem) SELECT count(DISTINCT item) AS n_items, round(avg(CASE WHEN t1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN t3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(CASE WHEN t5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(avg(CASE WHEN none THEN 1.0 ELSE 0.0 END), 6) AS unmatched
FROM (SELECT item, bool_or(ok AND place = 1) AS t1, bool_or(ok AND place <= 3) AS t3, bool_or(ok AND place <= 5) AS t5, NOT bool_or(hit) AS none FROM x GROUP BY 1)""")
def match_evaluation(s, d):
    x = t(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("place"), (F.col("l_returnflag") == "R").alias("ok"), (F.col("l_linestatus") == "F").alias("hit"))
    return A.match_evaluation(x, "item", "place", "ok", "hit")


@query("""WITH x AS (SELECT l_discount * 10 AS s, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'A' END AS ok, l_shipdate, l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS err FROM lineitem), th AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold),
g AS (SELECT threshold, count(*) FILTER (WHERE s >= threshold) AS n_kept, round(count(*) FILTER (WHERE s >= threshold) / count(*), 6) AS kept_rate, count(ok) FILTER (WHERE s >= threshold) AS n_labelled, round(sum(CASE WHEN ok AND s >= threshold THEN 1 ELSE 0 END) / nullif(count(ok) FILTER (WHERE s >= threshold), 0), 6) AS precision FROM x, th GROUP BY 1),
e AS (SELECT threshold, err, count(*) AS n FROM x, th WHERE s >= threshold AND NOT ok GROUP BY 1, 2), top AS (SELECT threshold, string_agg(err, ',' ORDER BY rn) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY n DESC, err) AS rn FROM e) WHERE rn <= 3 GROUP BY 1)
SELECT g.*, coalesce(errors, '') AS errors, coalesce(precision >= 0.5, false) AS passes, coalesce(threshold = (SELECT threshold FROM g WHERE precision >= 0.5 ORDER BY kept_rate DESC, threshold LIMIT 1), false) AS recommended FROM g LEFT JOIN top USING (threshold)""")
def threshold_decision(s, d):
    x = t(s, d, "lineitem").select((F.col("l_discount") * 10).alias("s"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("ok"), F.concat_ws("-", "l_linestatus", F.col("l_linenumber").cast("string")).alias("err"))
    return A.threshold_decision(x, "s", "ok", "err", [0.2, 0.4, 0.6, 0.8], 0.5)


@query("""SELECT grp, bucket, count(*) AS n, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM (SELECT unnest(['overall', CASE WHEN l_linenumber = 1 THEN 'single' ELSE 'majority' END]) AS grp, CASE WHEN l_tax >= 0.06 THEN 'high' WHEN l_tax >= 0.03 THEN 'medium' ELSE 'low' END AS bucket, l_returnflag = 'R' AS same FROM lineitem) GROUP BY 1, 2""")
def model_against_human(s, d):
    x = t(s, d, "lineitem").select((F.col("l_returnflag") == "R").alias("same"), F.when(F.col("l_linenumber") == 1, "single").otherwise("majority").alias("kind"), F.col("l_tax").alias("confidence"))
    return A.model_agreement(x, "same", "kind", "confidence", [("high", 0.06), ("medium", 0.03)])


_MRR = "WITH r AS (SELECT l_orderkey AS q, l_suppkey AS code, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_suppkey, l_linenumber) AS rank FROM lineitem), w AS (SELECT l_orderkey AS q, min(l_suppkey) AS want FROM lineitem GROUP BY 1)"


@query(_MRR + " SELECT count(*) AS n, round(avg(CASE WHEN code = want THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN code // 10 = want // 10 THEN 1.0 ELSE 0.0 END), 6) AS class_2, round(avg(CASE WHEN code // 100 = want // 100 THEN 1.0 ELSE 0.0 END), 6) AS class_1 FROM r JOIN w USING (q) WHERE rank = 1")
def class_accuracies(s, d):
    """Accuracy of the first candidate, whole and by prefix of its code."""
    w = W.partitionBy("l_orderkey")
    x = t(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_discount", "l_linenumber").withColumns({"rank": F.row_number().over(w.orderBy(F.desc("l_discount"), "l_suppkey", "l_linenumber")), "want": F.min("l_suppkey").over(w)}).filter("rank = 1")
    same = lambda k: F.round(F.avg((F.floor(F.col("l_suppkey") / k) == F.floor(F.col("want") / k)).cast("double")), 6)
    return x.agg(F.count("*").alias("n"), same(1).alias("exact"), same(10).alias("class_2"), same(100).alias("class_1"))


@query("""SELECT 'rank' AS profile, CASE WHEN l_linenumber <= 1 THEN 'top1' WHEN l_linenumber <= 3 THEN 'top3' ELSE 'rest' END AS bucket, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lineitem GROUP BY 2
UNION ALL SELECT 'confidence', CAST(least(CAST(floor(l_discount * 50) AS BIGINT), 4) AS VARCHAR), count(*), round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) FROM lineitem GROUP BY 2
UNION ALL SELECT 'voters', CAST(n AS VARCHAR), count(*), round(avg(rate), 6) FROM (SELECT l_orderkey, count(*) AS n, CASE WHEN bool_or(l_returnflag = 'R') THEN 1.0 ELSE 0.0 END AS rate FROM lineitem GROUP BY 1) GROUP BY 2
UNION ALL SELECT 'most frequent', b, n, NULL FROM (SELECT CAST(l_suppkey AS VARCHAR) AS b, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR)) AS rn FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) WHERE rn <= 20""")
def disagreement_profiles(s, d):
    x = t(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "l_suppkey").withColumn("off", (F.col("l_returnflag") == "R").cast("double"))
    part = lambda name, df, b: df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("off"), 6).alias("rate")).select(F.lit(name).alias("profile"), "bucket", "n", "rate")
    voters = x.groupBy("l_orderkey").agg(F.count("*").alias("v"), F.max("off").alias("off"))
    top = x.filter("off = 1").groupBy(F.col("l_suppkey").cast("string").alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket").limit(20)
    return part("rank", x, F.when(F.col("l_linenumber") <= 1, "top1").when(F.col("l_linenumber") <= 3, "top3").otherwise("rest")).unionByName(part("confidence", x, F.least(F.floor(F.col("l_discount") * 50), F.lit(4)).cast("string"))).unionByName(part("voters", voters, F.col("v").cast("string"))).unionByName(top.select(F.lit("most frequent").alias("profile"), "bucket", "n", F.lit(None).cast("double").alias("rate")))


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def findings_counted(s, d):
    """Findings once each, with their count and first place."""
    return t(s, d, "events", "user_id", "event_type", "event_id").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT pattern, n FROM (SELECT pattern, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, pattern) AS rn FROM (SELECT unnest(list_distinct(string_split(p_name || ' ' || p_type, ' '))) AS pattern FROM part) GROUP BY 1) WHERE rn <= 20")
def error_patterns(s, d):
    """The 20 most frequent patterns over records that may show several."""
    x = t(s, d, "part").select(F.explode(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))).alias("pattern"))
    return x.groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(20)


@query("""WITH x AS (SELECT l_discount AS c, l_shipmode AS k FROM (SELECT l_discount, l_linestatus || l_returnflag AS l_shipmode FROM lineitem)) SELECT count(*) AS n_rows, round(count(*) FILTER (WHERE c > 0) / count(*), 6) AS positive_rate, round(avg(c) FILTER (WHERE c > 0), 6) AS mean_positive, (SELECT string_agg(k || ':' || n, ',' ORDER BY n DESC, k) FROM (SELECT k, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, k LIMIT 5)) AS top5 FROM x""")
def batch_summary(s, d):
    x = t(s, d, "lineitem").select(F.col("l_discount").alias("c"), F.concat("l_linestatus", "l_returnflag").alias("k"))
    return A.batch_summary(x, "c", "k")


@query("SELECT month, count(*) AS n FROM (SELECT DISTINCT ON (strftime(created_at, '%Y-%m'), company_name, job_title) strftime(created_at, '%Y-%m') AS month FROM recruitment_jobs_normalized) GROUP BY 1")
def monthly_counts(s, d):
    x = t(s, d, JOBS, "created_at", "company_name", "job_title").select(F.date_format("created_at", "yyyy-MM").alias("month"), "company_name", "job_title").distinct()
    return x.groupBy("month").agg(F.count("*").alias("n"))


@query("""SELECT 'aliases' AS resource, occupation_major_category AS k1, is_terminal AS k2, count(*) AS n FROM (SELECT occupation_major_category, is_terminal, unnest(aliases) AS a FROM occ_dict_unified) GROUP BY 2, 3
UNION ALL SELECT 'tasks', occupation_major_category, is_terminal, count(*) FROM (SELECT occupation_major_category, is_terminal, unnest(task_list) AS a FROM occ_dict_unified) GROUP BY 2, 3
UNION ALL SELECT 'titles', occupation_major_category, is_terminal, count(*) FROM occ_dict_unified WHERE title <> '' GROUP BY 2, 3""")
def lexicon_summaries(s, d):
    """Sizes of a lexicon's resources, stacked."""
    o = t(s, d, "occ_dict_unified")
    size = lambda name, df: df.groupBy("occupation_major_category", "is_terminal").agg(F.count("*").alias("n")).select(F.lit(name).alias("resource"), F.col("occupation_major_category").alias("k1"), F.col("is_terminal").alias("k2"), "n")
    item = lambda c: o.select("occupation_major_category", "is_terminal", F.explode(c))
    return size("aliases", item("aliases")).unionByName(size("tasks", item("task_list"))).unionByName(size("titles", o.filter("title <> ''")))


@query("""WITH p AS (SELECT l_orderkey AS q, bool_or(l_discount >= 0.08) AS a, bool_or(l_tax >= 0.07) AS b FROM lineitem GROUP BY 1), g AS (SELECT q % 100 AS grp, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE b) AS nb FROM p GROUP BY 1)
SELECT grp, CASE WHEN na >= nb THEN 'discount' ELSE 'tax' END AS chosen, greatest(na, nb) AS passes FROM g""")
def strategies_compared(s, d):
    p = t(s, d, "lineitem", "l_orderkey", "l_discount", "l_tax").groupBy("l_orderkey").agg(F.max((F.col("l_discount") >= 0.08).cast("int")).alias("a"), F.max((F.col("l_tax") >= 0.07).cast("int")).alias("b")).withColumn("grp", F.col("l_orderkey") % 100)
    return R.compared_prefixes(p, "grp", {"discount": F.col("a") == 1, "tax": F.col("b") == 1})


@query("""SELECT CAST(l_orderkey AS BIGINT) AS id, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_correct, CASE WHEN l_returnflag <> 'R' AND l_linenumber % 3 = 0 THEN '' ELSE 'T' || (l_linenumber % 3) END AS gold_title, CASE WHEN l_returnflag = 'R' THEN '' WHEN l_linestatus = 'O' THEN 'other' ELSE 'wrong_class' END AS error_type FROM lineitem""")
def labels_without_contradiction(s, d):
    x = t(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "R", "true").otherwise("0").alias("is_correct"), F.concat(F.lit("T"), (F.col("l_linenumber") % 3).cast("string")).alias("gold_title"), F.when(F.col("l_linestatus") == "F", "wrong_class").otherwise("odd").alias("error_type"))
    return A.consistent_labels(x, "is_correct", "gold_title", F.lit("T0"), "error_type", ["wrong_class", "wrong_level"])


@query("""WITH g AS (SELECT task_id, list(DISTINCT code) AS gold FROM (SELECT task_id, unnest([cand_a_code, cand_b_code]) AS code FROM label_studio_tasks_v2) GROUP BY 1), c AS (SELECT DISTINCT task_id, unnest([cand_a_code, cand_b_code, cand_c_code, cand_d_code, cand_e_code]) AS code FROM label_studio_tasks_v2)
SELECT task_id, code, CASE WHEN list_contains(gold, code) THEN 'valid' ELSE 'not_skill' END AS label FROM c JOIN g USING (task_id) WHERE code <> '' AND (list_contains(gold, code) OR md5(task_id || '|' || code) < '8')""")
def weak_labels(s, d):
    """Candidates labelled by whether the gold list holds them; of the others a hashed half."""
    x = t(s, d, TASKS)
    gold = x.select("task_id", F.explode(F.array("cand_a_code", "cand_b_code")).alias("code")).groupBy("task_id").agg(F.collect_set("code").alias("gold"))
    cand = x.select("task_id", F.explode(F.array(*[f"cand_{c}_code" for c in "abcde"])).alias("code")).distinct().filter("code <> ''")
    return A.weak_labels(cand, gold, ["task_id"], "code", "gold", 0.5)


@query("""WITH s AS (SELECT task_id, CASE WHEN updated_by % 3 = 0 THEN 'C' ELSE chr(CAST(65 + updated_by % 2 AS INTEGER)) END AS choice, updated_by AS person, length(job_title) AS len FROM label_studio_tasks_v2), v AS (SELECT task_id, choice, count(*) AS support, mode(len ORDER BY len) AS modal_len FROM (SELECT DISTINCT task_id, choice, person, len FROM s WHERE len IS NOT NULL) GROUP BY 1, 2) SELECT task_id, choice, support, modal_len FROM (SELECT task_id, choice, support, (SELECT len FROM (SELECT len, count(*) AS c FROM (SELECT DISTINCT task_id, choice, person, len FROM s) z WHERE z.task_id = v.task_id AND z.choice = v.choice AND len IS NOT NULL GROUP BY 1 ORDER BY c DESC, len LIMIT 1)) AS modal_len FROM v)""")
def modal_votes(s, d):
    """Choices with their support and the value most voters gave with them."""
    x = t(s, d, TASKS).select("task_id", F.when(F.col("updated_by") % 3 == 0, "C").otherwise(F.char(65 + F.col("updated_by") % 2)).alias("choice"), F.col("updated_by").alias("person"), F.length("job_title").alias("len")).filter("len IS NOT NULL")
    return A.modal_votes(x, "task_id", "person", "choice", "len")


_CITY2 = "CASE WHEN c = '' THEN '未知' " + " ".join(f"WHEN contains(c, '{v}') THEN '{v}'" for v in X.GUANGDONG) + " ELSE '其他' END"


@query(f"""WITH b AS (SELECT recruitment_record_id, max(work_city) AS work_city, max(CASE WHEN contains(coalesce(job_description_raw, ''), '学历') THEN 1 ELSE 0 END) AS e, max(CASE WHEN contains(coalesce(job_description_raw, ''), '经验') THEN 1 ELSE 0 END) AS x, max(CASE WHEN contains(coalesce(job_description_raw, ''), '证') THEN 1 ELSE 0 END) AS z FROM {JOBS} GROUP BY 1),
y AS (SELECT CASE WHEN work_city IS NULL OR lower(regexp_replace(work_city, '^[\\s　]+|[\\s　]+$', '', 'g')) IN ('', 'nan') THEN '' ELSE regexp_replace(work_city, '^[\\s　]+|[\\s　]+$', '', 'g') END AS c, 2 * e + 2 * x + 3 * z AS idx FROM b), g AS (SELECT {_CITY2} AS city, count(*) AS n, round(avg(idx), 6) AS mean_stringency FROM y GROUP BY 1)
SELECT city, n, mean_stringency FROM (SELECT *, row_number() OVER (ORDER BY mean_stringency DESC, city) AS rn FROM g) WHERE rn <= 10""")
def stringency_by_city(s, d):
    has = lambda w: F.max(F.coalesce("job_description_raw", F.lit("")).contains(w).cast("int"))
    b = t(s, d, JOBS).groupBy("recruitment_record_id").agg(F.max("work_city").alias("c"), has("学历").alias("e"), has("经验").alias("x"), has("证").alias("z"))
    g = b.groupBy(X.city(F.col("c")).alias("city")).agg(F.count("*").alias("n"), F.round(F.avg(2 * F.col("e") + 2 * F.col("x") + 3 * F.col("z")), 6).alias("mean_stringency"))
    return g.orderBy(F.desc("mean_stringency"), "city").limit(10)


@query(f"SELECT industry, month, city, n, sum(n) OVER (PARTITION BY city, industry) AS total FROM (SELECT {_CITY2} AS city, CASE WHEN i = '' THEN '未知' ELSE i END AS industry, month, count(*) AS n FROM (SELECT CASE WHEN work_city IS NULL OR lower(trim(work_city)) IN ('', 'nan') THEN '' ELSE work_city END AS c, trim(string_split_regex(CASE WHEN company_industry_raw IS NULL OR lower(regexp_replace(company_industry_raw, '^[\\s　]+|[\\s　]+$', '', 'g')) IN ('', 'nan') THEN '' ELSE regexp_replace(company_industry_raw, '^[\\s　]+|[\\s　]+$', '', 'g') END, '[,，/、]+')[1]) AS i, strftime(created_at, '%Y-%m') AS month FROM {JOBS}) GROUP BY 1, 2, 3 HAVING count(*) >= 5)")
def city_industry_month(s, d):
    x = t(s, d, JOBS).select(X.city(F.col("work_city")).alias("city"), X.industry(F.col("company_industry_raw")).alias("industry"), F.date_format("created_at", "yyyy-MM").alias("month"))
    g = x.groupBy("city", "industry", "month").agg(F.count("*").alias("n")).filter("n >= 5")
    return g.withColumn("total", F.sum("n").over(W.partitionBy("city", "industry"))).select("industry", "month", "city", "n", "total")


@query(f"""WITH e AS (SELECT occupation_major_category AS category, code, year, education FROM (SELECT o.occupation_major_category, o.code, strftime(j.created_at, '%Y') AS year, CASE WHEN j.education_requirement_raw IS NULL OR j.education_requirement_raw = '' THEN '未明确' WHEN contains(j.education_requirement_raw, '不限') OR contains(j.education_requirement_raw, '无要求') THEN '学历不限' {' '.join(f"WHEN contains(j.education_requirement_raw, '{v}') THEN '{v}'" for v in X.DEGREES)} ELSE '未明确' END AS education FROM {JOBS} j JOIN occ_dict_unified o ON trim(j.job_title, ' ') = trim(o.title, ' ') WHERE o.is_terminal)),
g AS (SELECT category, year, education, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT *, round(n / sum(n) OVER (PARTITION BY category, year), 6) AS share FROM g""")
def category_year_education(s, d):
    o = t(s, d, "occ_dict_unified").filter("is_terminal").select(F.trim("title").alias("title"), F.col("occupation_major_category").alias("category"))
    x = t(s, d, JOBS).select(F.trim("job_title").alias("title"), F.date_format("created_at", "yyyy").alias("year"), X.education(F.col("education_requirement_raw")).alias("education")).join(o, "title")
    return R.with_share(x.groupBy("category", "year", "education").agg(F.count("*").alias("n")), "n", ["category", "year"])


@query(f"""WITH top AS (SELECT job_title FROM (SELECT job_title, row_number() OVER (ORDER BY count(*) DESC, job_title) AS rn FROM {JOBS} WHERE job_title IS NOT NULL GROUP BY 1) WHERE rn <= 15) SELECT lv AS level, job_title, count(*) AS n FROM (SELECT job_title, unnest(['本科', '硕士', '大专', '高中']) AS lv, education_requirement_raw AS e FROM {JOBS} JOIN top USING (job_title)) WHERE contains(e, lv) GROUP BY 1, 2 HAVING count(*) >= 3""")
def level_by_top_titles(s, d):
    j = t(s, d, JOBS, "job_title", "education_requirement_raw")
    levels = F.array(*[F.when(F.col("education_requirement_raw").contains(v), F.lit(v)) for v in ("本科", "硕士", "大专", "高中")])
    x = j.join(R.top_values(j, "job_title", 15), "job_title", "left_semi").select("job_title", F.explode(F.array_compact(levels)).alias("level"))
    return x.groupBy("level", "job_title").agg(F.count("*").alias("n")).filter("n >= 3")
