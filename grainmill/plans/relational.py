"""Queries over relational operators: joins, groupings, windows, limits, set operations and write semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.operators import relational as R
from grainmill.sources.tables import table as t
from grainmill.streaming import events as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _orders(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query("""WITH g AS (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT n_name, o_orderpriority, n, share FROM (SELECT c_nationkey, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY c_nationkey), 6) AS share FROM g) JOIN nation ON c_nationkey = n_nationkey WHERE n >= 10""")
def share_after_filter(s, d):
    g = _orders(s, d).groupBy("c_nationkey", "o_orderpriority").agg(F.count("*").alias("n"))
    g = R.with_share(g, "n", ["c_nationkey"]).filter("n >= 10")
    return g.join(F.broadcast(t(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "o_orderpriority", "n", "share")  # nation: a fixed list


@query("""WITH g AS (SELECT c_nationkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3 HAVING count(*) >= 12)
SELECT *, round(n / sum(n) OVER (PARTITION BY c_nationkey, o_orderpriority), 6) AS share FROM g""")
def share_before_filter(s, d):
    g = _orders(s, d).groupBy("c_nationkey", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).filter("n >= 12")
    return R.with_share(g, "n", ["c_nationkey", "o_orderpriority"])


@query("""SELECT p_brand, round(avg(l_extendedprice), 2) AS mean_price, round(median(l_extendedprice), 2) AS median_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def category_stats_median(s, d):
    x = t(s, d, "lineitem", "l_partkey", "l_extendedprice").join(t(s, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    p = F.col("l_extendedprice")
    g = x.groupBy("p_brand").agg(F.round(F.avg(p), 2).alias("mean_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.count("*").alias("n"))
    m = R.exact_quantile(x, ["p_brand"], "l_extendedprice", 0.5, "median_price").withColumn("median_price", F.round("median_price", 2))
    return g.join(m, "p_brand", "left")


@query("""SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 2) AS mean_price, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 10""")
def group_month_having(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count("*").alias("n")).filter("n >= 10")


@query("""SELECT p_brand, w AS word, count(*) AS n, round(sum(p_retailprice), 1) AS total_price FROM (SELECT DISTINCT p_partkey, p_brand, p_retailprice, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1, 2 HAVING count(*) >= 5""")
def multilabel_levels(s, d):
    x = t(s, d, "part").select("p_brand", "p_retailprice", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    return x.groupBy("p_brand", "word").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 1).alias("total_price")).filter("n >= 5")


@query("""WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) SELECT l_suppkey, strftime(l_shipdate, '%Y') AS year, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM top) GROUP BY 1, 2 HAVING count(*) >= 5""")
def topn_then_group(s, d):
    li = t(s, d, "lineitem", "l_suppkey", "l_shipdate", "l_quantity")
    x = li.join(R.top_values(li, "l_suppkey", 20), "l_suppkey", "left_semi")
    return x.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).filter("n >= 5")


@query("""WITH g AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 10), l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS previous FROM g)
SELECT event_type, day, n, previous, n - previous AS change, round((n - previous) / previous, 6) AS growth FROM l""")
def lag_growth(s, d):
    g = t(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).filter("n >= 10")
    return R.lagged(g, ["event_type"], ["day"], "n")


@query("""SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 2) AS mean_price, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 99 END AS rank FROM orders GROUP BY 1, 2 HAVING count(*) >= 10""")
def education_month_custom_order(s, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(99)
    g = t(s, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count("*").alias("n")).filter("n >= 10")
    return g.withColumn("rank", rank).orderBy("rank", "o_orderpriority", "month")


@query("""SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n, round(count(DISTINCT user_id) / greatest(1, (SELECT count(DISTINCT user_id) FROM events)), 6) AS share FROM events GROUP BY 1""")
def distinct_share(s, d):
    e = t(s, d, "events", "event_type", "user_id")
    total = e.agg(F.greatest(F.lit(1), F.countDistinct("user_id")).alias("all_users"))
    return e.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n")).join(F.broadcast(total)).select("event_type", "n_users", "n", F.round(F.col("n_users") / F.col("all_users"), 6).alias("share"))  # one row


@query("""SELECT education_requirement_raw, experience_requirement_raw, source_platform, count(*) AS n, count(DISTINCT recruitment_record_id) AS n_records FROM recruitment_jobs_normalized GROUP BY 1, 2, 3""")
def value_distribution(s, d):
    return t(s, d, "recruitment_jobs_normalized").groupBy("education_requirement_raw", "experience_requirement_raw", "source_platform").agg(F.count("*").alias("n"), F.countDistinct("recruitment_record_id").alias("n_records"))


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus, c_mktsegment, l_returnflag, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
x AS (SELECT 'segment' AS dimension, c_mktsegment AS value, l_linestatus, o_orderkey FROM b UNION ALL SELECT 'status', o_orderstatus, l_linestatus, o_orderkey FROM b UNION ALL SELECT 'flag', l_returnflag, l_linestatus, o_orderkey FROM b),
g AS (SELECT dimension, value, count(*) AS total FROM x GROUP BY 1, 2 HAVING count(*) >= 50)
SELECT dimension, value, l_linestatus, count(DISTINCT o_orderkey) AS n_orders, count(*) AS n, round(count(*) / min(total), 6) AS share FROM x JOIN g USING (dimension, value) GROUP BY 1, 2, 3""")
def multi_dim_breakdown(s, d):
    b = t(s, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus").join(t(s, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    x = b.select("l_linestatus", "o_orderkey", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in (("segment", "c_mktsegment"), ("status", "o_orderstatus"), ("flag", "l_returnflag"))])).alias("k")).select("k.dimension", "k.value", "l_linestatus", "o_orderkey")
    g = x.groupBy("dimension", "value", "l_linestatus").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.count("*").alias("n"))
    return g.withColumn("total", F.sum("n").over(W.partitionBy("dimension", "value"))).filter("total >= 50").select("dimension", "value", "l_linestatus", "n_orders", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT props) AS n_props FROM events GROUP BY 1""")
def noise_two_distincts(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("props").alias("n_props"))


@query("""WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS k, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, n, CAST(len(k) AS BIGINT) AS n_types, 3 * CAST(list_contains(k, 'purchase') AS INT) + 2 * CAST(list_contains(k, 'signup') AS INT) + CAST(list_contains(k, 'click') AS INT) - CAST(list_contains(k, 'error') AS INT) AS stringency FROM u""")
def stringency_index(s, d):
    u = t(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"), F.count("*").alias("n"))
    has = lambda v: F.array_contains("k", v).cast("int")
    return u.select("user_id", "n", F.size("k").cast("bigint").alias("n_types"), (3 * has("purchase") + 2 * has("signup") + has("click") - has("error")).alias("stringency"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE salary_raw IS NOT NULL AND trim(salary_raw) <> '') AS n_salary, count(*) FILTER (WHERE education_requirement_raw IS NOT NULL AND trim(education_requirement_raw) <> '') AS n_education, count(*) FILTER (WHERE publish_date IS NOT NULL AND trim(publish_date) <> '') AS n_date,
count(*) FILTER (WHERE recruitment_record_id IN (SELECT recruitment_record_id FROM label_studio_tasks_v2)) AS n_tasked, round(count(*) FILTER (WHERE recruitment_record_id IN (SELECT recruitment_record_id FROM label_studio_tasks_v2)) / greatest(1, count(*)), 6) AS tasked_share FROM recruitment_jobs_normalized""")
def coverage_counts(s, d):
    j = t(s, d, "recruitment_jobs_normalized", "recruitment_record_id", "salary_raw", "education_requirement_raw", "publish_date")
    m = t(s, d, "label_studio_tasks_v2", "recruitment_record_id").filter("recruitment_record_id IS NOT NULL").distinct().withColumn("hit", F.lit(1))
    said = lambda c: F.count(F.when(F.trim(c) != "", 1))
    return j.join(m, "recruitment_record_id", "left").agg(F.count("*").alias("n_rows"), said("salary_raw").alias("n_salary"), said("education_requirement_raw").alias("n_education"), said("publish_date").alias("n_date"), F.count("hit").alias("n_tasked")).withColumn("tasked_share", F.round(F.col("n_tasked") / F.greatest(F.lit(1), F.col("n_rows")), 6))


@query("""SELECT chunk, min(l_orderkey) AS range_start, max(l_orderkey) AS range_end, count(*) AS planned_rows FROM (SELECT l_orderkey, CAST(floor((l_orderkey - 1) / 5000) AS BIGINT) + 1 AS chunk FROM lineitem) GROUP BY 1""")
def chunk_ranges(s, d):
    return t(s, d, "lineitem", "l_orderkey").groupBy((F.floor((F.col("l_orderkey") - 1) / 5000) + 1).cast("bigint").alias("chunk")).agg(F.min("l_orderkey").alias("range_start"), F.max("l_orderkey").alias("range_end"), F.count("*").alias("planned_rows"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, max(l_extendedprice) AS most, count(*) AS n FROM lineitem GROUP BY 1""")
def percentile_summary(s, d):
    x = t(s, d, "lineitem", "l_returnflag", "l_extendedprice")
    out = x.groupBy("l_returnflag").agg(F.max("l_extendedprice").alias("most"), F.count("*").alias("n"))
    for q, name in ((0.5, "p50"), (0.95, "p95")):
        out = out.join(R.exact_quantile(x, ["l_returnflag"], "l_extendedprice", q, name), "l_returnflag", "left")
    return out.withColumns({"p50": F.round("p50", 4), "p95": F.round("p95", 4)})


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(s, d):
    return R.first_per_key(t(s, d, "events"), ["user_id"], [F.col("ts").desc_nulls_last(), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1""")
def best_per_key(s, d):
    return R.first_per_key(t(s, d, "events"), ["user_id"], [(F.col("event_type") == "purchase").desc(), F.col("value").desc_nulls_last(), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


_DUP = "md5(lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')))"


@query(f"""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {_DUP} ORDER BY collected_at NULLS LAST, doc_id) AS rn FROM documents) WHERE rn = 1""")
def keep_first_dedup(s, d):
    x = t(s, d, "documents", "doc_id", "source", "text", "collected_at").withColumn("k", F.md5(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\f\r ]+", ""))))
    return R.first_per_key(x, ["k"], [F.col("collected_at").asc_nulls_last(), F.col("doc_id")]).select("doc_id", "source")


@query("""SELECT recruitment_record_id, source_table, source_row_number, job_title FROM (SELECT *, row_number() OVER (PARTITION BY recruitment_record_id ORDER BY updated_at DESC NULLS LAST, source_table, source_row_number) AS rn FROM recruitment_jobs_normalized) WHERE rn = 1""")
def keep_last_dedup(s, d):
    x = t(s, d, "recruitment_jobs_normalized", "recruitment_record_id", "source_table", "source_row_number", "job_title", "updated_at")
    return R.first_per_key(x, ["recruitment_record_id"], [F.col("updated_at").desc_nulls_last(), F.col("source_table"), F.col("source_row_number")]).drop("updated_at")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_extendedprice DESC, l_partkey) AS r1 FROM lineitem), f AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_extendedprice DESC, l_partkey, l_orderkey) AS r2 FROM o WHERE r1 = 1)
SELECT l_suppkey, l_orderkey, l_linenumber FROM f WHERE r2 <= 100""")
def quota_fill(s, d):
    x = t(s, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return R.quota_fill(x, "l_suppkey", "l_orderkey", "l_linenumber", [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_orderkey")], 100).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, p_brand, turn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS turn FROM part) ORDER BY turn, md5(p_brand), p_brand, p_partkey LIMIT 300""")
def round_robin_sample(s, d):
    return R.round_robin(t(s, d, "part"), "p_brand", "p_partkey", 300).select("p_partkey", "p_brand", F.col("turn").cast("bigint").alias("turn"))


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_missing(s, d):
    return t(s, d, "customer", "c_custkey", "c_name").join(t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH top AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM top)""")
def semi_topn(s, d):
    top = t(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select(F.col("c_custkey").alias("o_custkey"))
    return t(s, d, "orders", "o_orderkey", "o_custkey").join(top, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT c_mktsegment, count(*) AS n, count(h) AS n_with_orders, count(*) - count(h) AS n_without FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, 1 AS h FROM orders) ON o_custkey = c_custkey GROUP BY 1""")
def presence_join(s, d):
    o = t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("h", F.lit(1))
    return t(s, d, "customer").join(o, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("h").alias("n_with_orders"), (F.count("*") - F.count("h")).alias("n_without"))


@query("""WITH l AS (SELECT task_id, nullif(recruitment_record_id, '') AS record, row_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC) AS rn FROM label_studio_tasks_v2) WHERE rn = 1), r AS (SELECT recruitment_record_id AS record, min(source_row_number) AS row_id, min(job_title) AS job_title FROM recruitment_jobs_normalized GROUP BY 1), r2 AS (SELECT row_id, min(job_title) AS job_title FROM r GROUP BY 1)
SELECT l.task_id, CASE WHEN l.record IS NOT NULL THEN r.job_title ELSE r2.job_title END AS job_title FROM l LEFT JOIN r ON l.record = r.record LEFT JOIN r2 ON l.record IS NULL AND l.row_id = r2.row_id""")
def left_alt_key(s, d):
    left = R.first_per_key(t(s, d, "label_studio_tasks_v2", "task_id", "recruitment_record_id", "row_id", "updated_at"), ["task_id"], [F.desc("updated_at")]).select("task_id", F.nullif(F.col("recruitment_record_id"), F.lit("")).alias("record"), "row_id")
    r = t(s, d, "recruitment_jobs_normalized").groupBy(F.col("recruitment_record_id").alias("record")).agg(F.min("source_row_number").alias("row_id"), F.min("job_title").alias("job_title"))
    # one row a record, and one a row number: each key of its own side
    by_row = r.filter("record IS NOT NULL").groupBy("row_id").agg(F.min("job_title").alias("job_title")).withColumn("record", F.lit(None).cast("string"))
    right = r.withColumn("row_id", F.lit(None).cast("bigint")).unionByName(by_row)
    return R.alternative_key_join(left, right, ["record"], ["row_id"]).select("task_id", "job_title")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'partial' END AS status, coalesce(nullif(trim(o_orderpriority), ''), 'none') AS priority FROM orders""")
def case_remap(s, d):
    st = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled").otherwise("partial")
    return t(s, d, "orders").select("o_orderkey", st.alias("status"), F.coalesce(F.nullif(F.trim("o_orderpriority"), F.lit("")), F.lit("none")).alias("priority"))


@query("""SELECT recruitment_record_id, source_table, source_row_number, coalesce(nullif(job_description_raw, ''), nullif(job_title, ''), nullif(company_name, '')) AS match_text, CASE WHEN nullif(job_description_raw, '') IS NOT NULL THEN 'description' WHEN nullif(job_title, '') IS NOT NULL THEN 'title' WHEN nullif(company_name, '') IS NOT NULL THEN 'company' END AS match_source FROM recruitment_jobs_normalized""")
def priority_coalesce(s, d):
    c = {"description": "job_description_raw", "title": "job_title", "company": "company_name"}
    src = F.coalesce(*[F.when(F.nullif(F.col(v), F.lit("")).isNotNull(), F.lit(k)) for k, v in c.items()])
    return t(s, d, "recruitment_jobs_normalized").select("recruitment_record_id", "source_table", "source_row_number", R.non_empty(*map(F.col, c.values())).alias("match_text"), src.alias("match_source"))


@query("""SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_props(s, d):
    return t(s, d, "events").groupBy("user_id", F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT task_id, slot, code, title, source FROM (SELECT task_id, row_id, unnest(['A','B','C','D','E']) AS slot, unnest([cand_a_code, cand_b_code, cand_c_code, cand_d_code, cand_e_code]) AS code, unnest([cand_a_title, cand_b_title, cand_c_title, cand_d_title, cand_e_title]) AS title, unnest([cand_a_source, cand_b_source, cand_c_source, cand_d_source, cand_e_source]) AS source FROM label_studio_tasks_v2) WHERE code IS NOT NULL AND code <> ''""")
def unpivot_slots(s, d):
    x = t(s, d, "label_studio_tasks_v2")
    slots = F.array(*[F.struct(F.lit(c.upper()).alias("slot"), F.col(f"cand_{c}_code").alias("code"), F.col(f"cand_{c}_title").alias("title"), F.col(f"cand_{c}_source").alias("source")) for c in "abcde"])
    return x.select("task_id", F.explode(slots).alias("z")).select("task_id", "z.*").filter("code IS NOT NULL AND code <> ''")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (WHERE rn = 1) AS top1_key, max(o_totalprice) FILTER (WHERE rn = 1) AS top1_price, max(o_orderkey) FILTER (WHERE rn = 2) AS top2_key, max(o_totalprice) FILTER (WHERE rn = 2) AS top2_price, round(max(o_totalprice) FILTER (WHERE rn = 1) - max(o_totalprice) FILTER (WHERE rn = 2), 4) AS margin FROM r WHERE rn <= 2 GROUP BY 1""")
def pivot_topk(s, d):
    x = t(s, d, "orders").withColumn("rn", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("rn <= 2")
    at = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    return x.groupBy("o_custkey").agg(at("o_orderkey", 1).alias("top1_key"), at("o_totalprice", 1).alias("top1_price"), at("o_orderkey", 2).alias("top2_key"), at("o_totalprice", 2).alias("top2_price"), F.round(at("o_totalprice", 1) - at("o_totalprice", 2), 4).alias("margin"))


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'customer only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""")
def value_set_ops(s, d):
    a, b = t(s, d, "customer").select(F.col("c_custkey").alias("k")), t(s, d, "orders").select(F.col("o_custkey").alias("k"))
    n = lambda x, side: x.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.distinct().exceptAll(b.distinct()), "customer only")).unionByName(n(a.union(b).distinct(), "either"))


@query("""SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_by_name(s, d):
    a = t(s, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT source, n_hits, sum(n_hits) OVER (ORDER BY n_hits DESC, source) AS cumulative FROM (SELECT event_type AS source, count(*) AS n_hits FROM events GROUP BY 1)""")
def cumulative_hits(s, d):
    g = t(s, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n_hits"))
    return g.withColumn("cumulative", F.sum("n_hits").over(W.orderBy(F.desc("n_hits"), "source").rowsBetween(W.unboundedPreceding, 0)))  # a handful of groups


@query("""SELECT * FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS rank FROM customer GROUP BY 1, 2) WHERE rank <= 3""")
def top_listing_per_group(s, d):
    g = t(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment")).cast("bigint")).filter("rank <= 3")


@query("""WITH e AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT i.c_custkey, CASE WHEN e.c_custkey IS NOT NULL THEN md5(CAST(e.c_custkey AS VARCHAR)) ELSE md5('new' || i.c_name) END AS record_id FROM i LEFT JOIN e ON i.c_custkey = e.c_custkey""")
def frozen_identity_upsert(s, d):
    c = t(s, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.md5(F.col("c_custkey").cast("string")).alias("record_id"), "c_custkey", "c_name")
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return R.upsert_frozen(old, new, "record_id", [["c_custkey"], ["c_name"]], F.md5(F.concat(F.lit("new"), "c_name"))).select("c_custkey", "record_id")


@query("""WITH e AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0), i AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(e.s_suppkey, i.s_suppkey) AS s_suppkey, CASE WHEN i.s_suppkey IS NOT NULL THEN i.s_name ELSE e.s_name END AS s_name, CASE WHEN i.s_suppkey IS NOT NULL THEN i.s_acctbal ELSE e.s_acctbal END AS s_acctbal, CASE WHEN e.s_suppkey IS NULL THEN 'inserted' WHEN i.s_suppkey IS NOT NULL AND (e.s_name IS DISTINCT FROM i.s_name OR e.s_acctbal IS DISTINCT FROM i.s_acctbal) THEN 'updated' ELSE 'kept' END AS action FROM e FULL JOIN i ON e.s_suppkey = i.s_suppkey""")
def conditional_upsert(s, d):
    x = t(s, d, "supplier", "s_suppkey", "s_name", "s_acctbal")
    new = x.filter("s_suppkey % 2 = 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return R.conditional_upsert(x.filter("s_suppkey % 4 <> 0"), new, ["s_suppkey"], ["s_name", "s_acctbal"])


@query("""WITH a AS (SELECT c_nationkey AS k, max(c_acctbal) AS v, min(c_name) AS w FROM customer WHERE c_nationkey < 15 GROUP BY 1), b AS (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier WHERE s_nationkey > 5 GROUP BY 1)
SELECT coalesce(n_nationkey, a.k, b.k) AS k, coalesce(b.v, a.v) AS v, coalesce(a.w, n_name) AS w, a.k IS NOT NULL AS from_customer, b.k IS NOT NULL AS from_supplier FROM nation FULL JOIN a ON n_nationkey = a.k FULL JOIN b ON coalesce(n_nationkey, a.k) = b.k""")
def enriching_merge(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(None).cast("double").alias("v"), F.col("n_name").alias("w"))
    a = t(s, d, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"), F.min("c_name").alias("w"))
    b = t(s, d, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"))
    return R.enriching_merge(n, [("customer", a), ("supplier", b)], "k", ["v", "w"])


@query("""SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 2 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2""")
def insert_if_absent(s, d):
    r = t(s, d, "region", "r_regionkey", "r_name")
    return R.insert_absent(r.filter("r_regionkey < 2"), r, ["r_regionkey"])


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def cube_totals(s, d):
    return t(s, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 hours THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 hours AS session_end, count(*) AS n FROM s GROUP BY user_id, sess""")
def events_sessions(s, d):
    x = streams.sessions(t(s, d, "events", "ts", "user_id"), "ts", "user_id", "6 hours")
    return x.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("""WITH x AS (SELECT o_orderkey, o_orderpriority AS region, unnest(string_split(c_mktsegment || ',' || o_orderstatus, ',')) AS tag FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT tag, count(*) AS n, min(o_orderkey) AS first_order FROM x GROUP BY 1 HAVING count(*) >= 3)
SELECT tag, n, first_order, CASE WHEN regexp_matches(tag, 'AUTO|MACH') THEN 'goods' WHEN regexp_matches(tag, 'BUILD|FURN|HOUSE') THEN 'home' ELSE 'other' END AS dimension FROM g ORDER BY n DESC, tag LIMIT 20""")
def seed_counts(s, d):
    """Tags out of comma lists, counted, the first of each kept as a sample, placed by the first keyword met; the 20 most frequent."""
    x = _orders(s, d).select("o_orderkey", F.explode(F.split(F.concat_ws(",", "c_mktsegment", "o_orderstatus"), ",")).alias("tag"))
    g = x.groupBy("tag").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order")).filter("n >= 3")
    kind = F.when(F.col("tag").rlike("AUTO|MACH"), "goods").when(F.col("tag").rlike("BUILD|FURN|HOUSE"), "home").otherwise("other")
    return g.withColumn("dimension", kind).orderBy(F.desc("n"), "tag").limit(20)
