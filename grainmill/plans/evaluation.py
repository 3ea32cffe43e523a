"""Queries over votes and evaluation, retrieval, dictionary matching, resolution and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.functions import text as X
from grainmill.operators import agreement as A
from grainmill.operators import graph, sections, skills
from grainmill.operators import relational as R
from grainmill.operators import retrieval as V
from grainmill.plans.textual import TOKENS_SQL
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


# events as votes: a user (voter) names a type (choice) for an hour (item)
_VOTES = "WITH v AS (SELECT strftime(ts, '%Y-%m-%d %H') AS item, user_id AS voter, event_type AS choice FROM events), c AS (SELECT item, choice, count(*) AS n_choice FROM v GROUP BY 1, 2), m AS (SELECT item, choice, n_choice, sum(n_choice) OVER (PARTITION BY item) AS n_votes, sum(n_choice * (n_choice - 1)) OVER (PARTITION BY item) AS same, row_number() OVER (PARTITION BY item ORDER BY n_choice DESC, choice) AS r FROM c)"


def _votes(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("item"), F.col("user_id").alias("voter"), F.col("event_type").alias("choice"))


@query(_VOTES + " SELECT item, choice, n_choice, CAST(n_votes AS BIGINT) AS n_votes, n_choice * 2 > n_votes AS strict, n_choice = n_votes AS unanimous, CASE WHEN n_votes > 1 THEN round(same / (n_votes * (n_votes - 1)), 6) END AS pair_agreement FROM m WHERE r = 1")
def majority_pairwise(s, d):
    return A.majority(_votes(s, d), "item", "choice")


@query(_VOTES + ", w AS (SELECT item, choice FROM m WHERE r = 1 AND n_votes >= 2) SELECT voter, count(*) AS n_items, round(avg(CASE WHEN v.choice = w.choice THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM v JOIN w ON v.item = w.item GROUP BY 1")
def annotator_quality(s, d):
    return A.voter_quality(_votes(s, d), "item", "voter", "choice")


@query(_VOTES + " SELECT item, choice, count(DISTINCT voter) AS support FROM v GROUP BY 1, 2 HAVING count(DISTINCT voter) >= 3")
def vote_aggregate(s, d):
    return A.vote_aggregate(_votes(s, d), "item", "voter", "choice", 3)


@query(_VOTES + """, q AS (SELECT item, n_votes, CASE WHEN n_choice = n_votes AND n_votes >= 3 THEN 'S' WHEN n_choice = n_votes AND n_votes >= 2 THEN 'A' WHEN n_choice * 2 > n_votes AND n_votes >= 2 THEN 'B' WHEN n_votes >= 2 THEN 'C' ELSE 'D' END AS tier FROM m WHERE r = 1) SELECT tier, count(*) AS n_items, CAST(sum(n_votes) AS BIGINT) AS n_votes FROM q GROUP BY 1""")
def quality_tiers(s, d):
    m = A.majority(_votes(s, d), "item", "choice").withColumn("tier", A.quality_tier(F.col("unanimous"), F.col("strict"), F.col("n_votes")))
    return m.groupBy("tier").agg(F.count("*").alias("n_items"), F.sum("n_votes").alias("n_votes"))


@query("""SELECT p_partkey, size_tier, copy FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'S' WHEN p_size > 30 THEN 'A' WHEN p_size > 10 THEN 'B' ELSE 'D' END AS size_tier FROM part) JOIN (SELECT * FROM (VALUES ('S', 10), ('A', 7), ('B', 3)) v(tier, m)) ON size_tier = tier, LATERAL (SELECT unnest(range(1, m + 1)) AS copy)""")
def tier_oversample(s, d):
    p = t(s, d, "part", "p_partkey", "p_size").select("p_partkey", F.when(F.col("p_size") > 45, "S").when(F.col("p_size") > 30, "A").when(F.col("p_size") > 10, "B").otherwise("D").alias("size_tier"))
    return A.oversample(p, "size_tier", {"S": 10, "A": 7, "B": 3, "D": 0}).withColumn("copy", F.col("copy").cast("bigint"))


@query("""SELECT threshold, count(*) FILTER (WHERE s >= threshold) AS n_kept, round(count(*) FILTER (WHERE s >= threshold) / count(*), 6) AS kept_rate, count(c) FILTER (WHERE s >= threshold) AS n_labelled, round(sum(c) FILTER (WHERE s >= threshold) / count(c) FILTER (WHERE s >= threshold), 6) AS precision
FROM (SELECT l_discount * 10 AS s, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS c FROM lineitem), (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold) GROUP BY 1""")
def threshold_sweep(s, d):
    x = t(s, d, "lineitem", "l_discount", "l_returnflag").select((F.col("l_discount") * 10).alias("s"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("c"))
    return A.threshold_sweep(x, "s", "c", [0.2, 0.4, 0.6, 0.8])


_SETS = "WITH p AS (SELECT user_id, list_distinct(list(event_type)) AS p FROM events WHERE value > 30 GROUP BY 1), g AS (SELECT user_id, list_distinct(list(event_type)) AS g FROM events WHERE value > 45 GROUP BY 1), x AS (SELECT coalesce(p, []) AS p, coalesce(g, []) AS g FROM p FULL JOIN g ON p.user_id = g.user_id)"


def _sets(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events")
    return e.filter("value > 30").groupBy("user_id").agg(F.collect_set("event_type").alias("p")).join(e.filter("value > 45").groupBy("user_id").agg(F.collect_set("event_type").alias("g")), "user_id", "full_outer")


@query(_SETS + ", y AS (SELECT len(list_intersect(p, g)) AS tp, len(p) - len(list_intersect(p, g)) AS fp, len(g) - len(list_intersect(p, g)) AS fn FROM x) SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, round(avg(CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_rate FROM y")
def set_prf1(s, d):
    return A.set_scores(_sets(s, d), "p", "g")


@query(_SETS + ", y AS (SELECT len(list_filter(g, lambda a: len(list_filter(p, lambda b: contains(a, b) OR contains(b, a))) > 0)) AS hg, len(g) AS ng, len(list_filter(p, lambda a: len(list_filter(g, lambda b: contains(a, b) OR contains(b, a))) > 0)) AS hp, len(p) AS np FROM x) SELECT round(sum(hg) / sum(ng), 6) AS coverage, round(sum(hp) / sum(np), 6) AS precision FROM y")
def fuzzy_prf(s, d):
    return A.fuzzy_scores(_sets(s, d), "p", "g")


@query("""WITH x AS (SELECT l_returnflag AS a, CASE WHEN l_tax > 0.04 THEN 'R' WHEN l_discount > 0.05 THEN 'A' ELSE 'N' END AS p FROM lineitem), c AS (SELECT c, sum(tp) AS tp, sum(np) AS np, sum(na) AS na FROM (SELECT p AS c, CAST(p = a AS INT) AS tp, 1 AS np, 0 AS na FROM x UNION ALL SELECT a, 0, 0, 1 FROM x) GROUP BY 1)
SELECT round(sum(tp) / sum(na), 6) AS accuracy, round(avg(2 * tp / (np + na)), 6) AS macro_f1 FROM c""")
def macro_f1(s, d):
    x = t(s, d, "lineitem", "l_returnflag", "l_tax", "l_discount").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_tax") > 0.04, "R").when(F.col("l_discount") > 0.05, "A").otherwise("N").alias("p"))
    return A.macro_f1(x, "p", "a")


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@query(f"""WITH r AS (SELECT q.vec_id AS query_key, e.vec_id AS vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT query_key, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10""")
def cosine_topk(s, d):
    e = t(s, d, "embeddings", "vec_id", "embedding")
    return V.cosine_top_k(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 10).select("query_key", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH r AS (SELECT q.vec_id AS query_key, q.label = e.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0), f AS (SELECT query_key, min(rank) FILTER (WHERE same AND rank <= 50) AS first FROM r GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce(1.0 / first, 1.0 / 51)), 6) AS mrr, round(avg(coalesce(first, 51)), 4) AS mean_rank, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1 FROM f""")
def mrr_rank(s, d):
    e = t(s, d, "embeddings", "vec_id", "embedding", "label")
    top = V.cosine_top_k(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 50)
    x = top.join(e.select(F.col("vec_id").alias("query_key"), F.col("label").alias("want")), "query_key").join(e.select("vec_id", "label"), "vec_id")
    first = x.groupBy("query_key").agg(F.min(F.when(F.col("want") == F.col("label"), F.col("rank"))).alias("first"))
    r = F.coalesce("first", F.lit(51))
    return first.agg(F.count("*").alias("n_queries"), F.round(F.avg(1.0 / r), 6).alias("mrr"), F.round(F.avg(r), 4).alias("mean_rank"), F.round(F.avg((F.coalesce("first", F.lit(0)) == 1).cast("double")), 6).alias("top1"))


@query(f"""WITH d AS (SELECT doc_id, {TOKENS_SQL.format(c='text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), p AS (SELECT doc_id, len, tok, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS tok FROM d) GROUP BY 1, 2, 3), f AS (SELECT tok, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT code, tok, count(*) AS qtf FROM (SELECT code, unnest({TOKENS_SQL.format(c="(title || ' ' || array_to_string(aliases, ' '))")}) AS tok FROM occ_dict_unified WHERE is_terminal) GROUP BY 1, 2),
s AS (SELECT code, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))) AS score FROM q JOIN f ON q.tok = f.tok JOIN p ON p.tok = q.tok, st GROUP BY 1, 2)
SELECT code, doc_id, round(score, 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(score, 3) DESC, doc_id) AS rn FROM s) WHERE rn <= 5""")
def bm25_search(s, d):
    """Occupations by title and aliases against all texts: Latin words and pairs of Han characters."""
    docs = t(s, d, "documents", "doc_id", "text").select("doc_id", V.tokens(F.col("text")).alias("w"))
    q = t(s, d, "occ_dict_unified").filter("is_terminal").select("code", V.tokens(F.concat("title", F.lit(" "), F.array_join("aliases", " "))).alias("qw"))
    r = V.bm25(docs, "doc_id", "w", q, "code", "qw")
    return R.top_k_per_group(r, ["code"], [F.round("score", 3).desc(), F.col("doc_id")], 5).withColumn("score", F.round("score", 2))


_GRAM = "list_distinct(list_transform(range(1, greatest(length(title) - 1, 1) + 1), lambda i: substring(title, i, 2)))"


@query(f"""WITH x AS (SELECT code, {_GRAM} AS g FROM occ_dict_unified WHERE is_terminal AND title <> ''), p AS (SELECT a.code AS code_a, b.code AS code_b, len(list_intersect(a.g, b.g)) AS i, len(a.g) AS na, len(b.g) AS nb FROM x a JOIN x b ON a.code < b.code)
SELECT code_a, code_b, round(i / (na + nb - i), 6) AS score FROM p WHERE i / (na + nb - i) >= 0.4""")
def ngram_jaccard(s, d):
    x = t(s, d, "occ_dict_unified").filter("is_terminal AND title <> ''").select("code", V.ngrams(F.col("title")).alias("g"))
    r = V.ngram_jaccard(x.withColumnRenamed("code", "code_a"), "code_a", x.withColumnRenamed("code", "code_b"), "code_b", "g", 0.4)
    return r.filter("code_a < code_b").withColumn("score", F.round("score", 6))


@query("""WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice AS a, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS b FROM orders), n AS (SELECT *, CASE WHEN max(a) OVER w = min(a) OVER w THEN CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END ELSE (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) END AS na, CASE WHEN max(b) OVER w = min(b) OVER w THEN CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END AS nb FROM m WINDOW w AS (PARTITION BY o_custkey)),
f AS (SELECT o_custkey, o_orderkey, 0.6 * na + 0.4 * nb AS score FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS rn, lead(score) OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS nx FROM f), z AS (SELECT o_custkey, o_orderkey AS best, round(score, 6) AS score, score AS raw, round(score - coalesce(nx, 0), 6) AS margin FROM r WHERE rn = 1)
SELECT o_custkey, best, score, margin, concat_ws(',', CASE WHEN margin < 0.05 THEN 'small_margin' END, CASE WHEN raw < 0.6 THEN 'low_score' END) AS flags, CASE WHEN margin < 0.05 THEN 'low' WHEN raw < 0.6 THEN 'medium' ELSE 'high' END AS level FROM z""")
def fused_scores_flags(s, d):
    o = t(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("a"), F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double").alias("b"))
    return V.confidence(V.fuse(o, "o_custkey", {"a": 0.6, "b": 0.4}), "o_custkey", "o_orderkey", "score", 0.05, 0.6)


@query("""WITH j AS (SELECT DISTINCT regexp_replace(job_title, '^ +| +$', '', 'g') AS title FROM recruitment_jobs_normalized WHERE regexp_replace(job_title, '^ +| +$', '', 'g') <> ''), o AS (SELECT min(code) AS code, regexp_replace(title_clean, '^ +| +$', '', 'g') AS name FROM occ_dict_unified WHERE is_terminal GROUP BY 2), e AS (SELECT title, code, 100 AS score FROM j JOIN o ON title = name), c AS (SELECT title, code, row_number() OVER (PARTITION BY title ORDER BY length(name) DESC, code) AS rn FROM j JOIN o ON contains(lower(title), lower(name)) WHERE title NOT IN (SELECT title FROM e))
SELECT title, code, score FROM e UNION ALL SELECT title, code, 95 FROM c WHERE rn = 1""")
def rule_tier_ladder(s, d):
    j = t(s, d, JOBS).select(F.trim("job_title").alias("title")).filter("title <> ''").distinct()
    o = t(s, d, "occ_dict_unified").filter("is_terminal").groupBy(F.trim("title_clean").alias("name")).agg(F.min("code").alias("code"))
    e = j.join(o, j["title"] == o["name"]).select("title", "code", F.lit(100).alias("score"))
    rest = j.join(e.select("title"), "title", "left_anti")
    c = skills.contained_terms(rest, "title", "title", o, "name").join(o.select(F.lower("name").alias("term"), "name", "code"), "term")
    return e.unionByName(R.first_per_key(c, ["title"], [F.length("name").desc(), F.col("code")]).select("title", "code", F.lit(95).alias("score")))


_WORDS = ["shopify", "erp", "excel", "python", "sql", "hplc", "ros", "plc", "数据核对", "合规检查", "风险排查", "样本抽查"]
_LIST = ", ".join(f"'{w}'" for w in _WORDS)


@query(f"""SELECT DISTINCT doc_id, term FROM documents, (SELECT unnest([{_LIST}]) AS term) WHERE contains(lower(text), term)""")
def contains_theta_join(s, d):
    terms = s.createDataFrame([(w,) for w in _WORDS], "term string")
    return skills.contained_terms(t(s, d, "documents", "doc_id", "text"), "doc_id", "text", terms, "term")


_FOUND = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)') THEN '{w}' END" if w.isascii() else f"CASE WHEN contains(text, '{w}') THEN '{w}' END" for w in sorted(_WORDS))


@query(f"SELECT doc_id, array_to_string(list_filter([{_FOUND}], lambda x: x IS NOT NULL), ',') AS found FROM documents")
def run_skill_match(s, d):
    """The listed skills of every text; Latin ones not inside a longer word or number."""
    x = t(s, d, "documents", "doc_id", "text").withColumn("f", skills.matcher(_WORDS)(F.col("text")))
    return x.select("doc_id", F.array_join(F.array_sort("f"), ",").alias("found"))


@query()
def skill_matches(s, d):
    """The Latin skills of every text that is not NULL."""
    x = t(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return x.select("doc_id", F.array_join(F.array_sort(skills.matcher([w for w in _WORDS if w.isascii()])(F.col("text"))), ",").alias("found"))


@query()
def skill_names(s, d):
    """Documents by canonical skill, category and confidence, terms inside longer ones left out."""
    entries = [("SQL", "tool", None), ("Python", "tool", None), ("电子表格", "office", "excel"), ("企业资源计划", "office", "erp"), ("核对", "action", "数据核对"), ("排查", "action", "风险排查")]
    dic = s.createDataFrame(entries, "name string, category string, alias string")
    terms = [x for n, _, a in entries for x in (n, a) if x]
    f = t(s, d, "documents", "doc_id", "text").withColumn("f", skills.matcher(terms)(F.col("text"))).select("doc_id", F.explode(skills.drop_substrings(F.col("f"))).alias("term"))
    return skills.resolve(f, "term", dic).groupBy("name", "category", "confidence").agg(F.countDistinct("doc_id").alias("n_docs"))


@query()
def description_sections(s, d):
    """Sections and items of each description: counts per record."""
    x = t(s, d, JOBS, "recruitment_record_id", "job_description_raw").filter("recruitment_record_id IS NOT NULL").distinct()
    return sections.sectioned(x, "job_description_raw").select("recruitment_record_id", "sections_brief", "query_source", F.length("requirements_text").alias("n_requirements"), F.length("duties_text").alias("n_duties"))


@query("""WITH l AS (SELECT task_id, nullif(recruitment_record_id, '') AS rid, job_title FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC) AS rn FROM label_studio_tasks_v2) WHERE rn = 1), j AS (SELECT DISTINCT recruitment_record_id AS rid, job_title, lower(regexp_replace(coalesce(job_title, ''), '[\\t\\n\\f\\r ]+', '', 'g')) AS k FROM recruitment_jobs_normalized),
a AS (SELECT job_title, min(rid) AS rid, count(DISTINCT rid) AS n FROM j WHERE job_title <> '' GROUP BY 1), b AS (SELECT k, min(rid) AS rid, count(DISTINCT rid) AS n FROM j WHERE k <> '' GROUP BY 1)
SELECT l.task_id, CASE WHEN l.rid IS NOT NULL THEN l.rid WHEN a.n = 1 THEN a.rid WHEN b.n = 1 THEN b.rid END AS record_id, CASE WHEN l.rid IS NOT NULL THEN 'given' WHEN a.n = 1 THEN 'exact_title' WHEN b.n = 1 THEN 'normal_title' WHEN coalesce(a.n, b.n, 0) > 1 THEN 'review' ELSE 'unmatched' END AS rung
FROM l LEFT JOIN a ON l.job_title = a.job_title LEFT JOIN b ON lower(regexp_replace(coalesce(l.job_title, ''), '[\\t\\n\\f\\r ]+', '', 'g')) = b.k""")
def entity_resolution(s, d):
    left = R.first_per_key(t(s, d, TASKS, "task_id", "recruitment_record_id", "job_title", "updated_at"), ["task_id"], [F.desc("updated_at")])
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\n\f\r ]+", ""))
    left = left.select("task_id", F.nullif(F.col("recruitment_record_id"), F.lit("")).alias("rid"), "job_title", plain("job_title").alias("k"))
    j = t(s, d, JOBS, "recruitment_record_id", "job_title").select(F.col("recruitment_record_id").alias("r"), "job_title", plain("job_title").alias("k")).distinct()
    rung = lambda key, p: j.filter(f"{key} <> ''").groupBy(key).agg(F.min("r").alias(f"{p}_id"), F.countDistinct("r").alias(f"{p}_n"))
    x = left.join(rung("job_title", "a"), "job_title", "left").join(rung("k", "b"), "k", "left")
    one = lambda p: F.coalesce(F.col(f"{p}_n") == 1, F.lit(False))
    rid = F.when(F.col("rid").isNotNull(), F.col("rid")).when(one("a"), F.col("a_id")).when(one("b"), F.col("b_id"))
    step = F.when(F.col("rid").isNotNull(), "given").when(one("a"), "exact_title").when(one("b"), "normal_title").when(F.coalesce("a_n", "b_n", F.lit(0)) > 1, "review").otherwise("unmatched")
    return x.select("task_id", rid.alias("record_id"), step.alias("rung"))


@query(f"""WITH RECURSIVE x AS (SELECT code, {_GRAM} AS g FROM occ_dict_unified WHERE is_terminal AND title <> ''), p AS (SELECT a.code AS x, b.code AS y FROM x a JOIN x b ON a.code <> b.code AND len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.55), r AS (SELECT code AS id, code AS root FROM x UNION SELECT p.y, r.root FROM r JOIN p ON r.id = p.x)
SELECT id AS code, min(root) AS component FROM r GROUP BY 1""")
def similar_components(s, d):
    x = t(s, d, "occ_dict_unified").filter("is_terminal AND title <> ''").select("code", V.ngrams(F.col("title")).alias("g"))
    e = V.ngram_jaccard(x.withColumnRenamed("code", "x"), "x", x.withColumnRenamed("code", "y"), "y", "g", 0.55).filter("x < y")
    return graph.components(e, x.select(F.col("code").alias("id"))).withColumnRenamed("id", "code")


@query("""SELECT row_id, split FROM (SELECT row_id, label, CASE WHEN rn <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * 0.9) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT row_id, label FROM train_set WHERE label IS NOT NULL)))""")
def stratified_split(s, d):
    x = t(s, d, "train_set", "row_id", "label").filter("label IS NOT NULL").distinct()
    w = W.partitionBy("label")
    x = x.withColumns({"rn": F.row_number().over(w.orderBy(F.md5(F.col("row_id").cast("string")), "row_id")), "n": F.count("*").over(w)})
    return x.select("row_id", F.when(F.col("rn") <= F.floor(F.col("n") * 0.8), "train").when(F.col("rn") <= F.floor(F.col("n") * 0.9), "val").otherwise("test").alias("split"))


@query("""SELECT slot, source, count(*) AS n, count(*) FILTER (WHERE code IN (SELECT code FROM occ_dict_unified WHERE is_terminal)) AS n_leaf FROM (SELECT unnest(['A','B','C','D','E']) AS slot, unnest([cand_a_code, cand_b_code, cand_c_code, cand_d_code, cand_e_code]) AS code, unnest([cand_a_source, cand_b_source, cand_c_source, cand_d_source, cand_e_source]) AS source FROM label_studio_tasks_v2) GROUP BY 1, 2""")
def candidate_sources(s, d):
    z = F.array(*[F.struct(F.lit(c.upper()).alias("slot"), F.col(f"cand_{c}_code").alias("code"), F.col(f"cand_{c}_source").alias("source")) for c in "abcde"])
    leaf = t(s, d, "occ_dict_unified").filter("is_terminal").select("code", F.lit(1).alias("leaf")).distinct()
    x = t(s, d, TASKS).select(F.explode(z).alias("z")).select("z.*").join(leaf, "code", "left")
    return x.groupBy("slot", "source").agg(F.count("*").alias("n"), F.count("leaf").alias("n_leaf"))


@query(f"""SELECT code, code_parent, CAST(n_tasks AS BIGINT) AS n_tasks, hierarchy FROM (SELECT code, array_to_string(string_split(code, '-')[1:2], '-') AS code_parent, len(task_list) AS n_tasks, concat_ws(' > ', nullif(occupation_major_category, ''), nullif(occupation_middle_category, ''), nullif(trim(title), '')) AS hierarchy FROM occ_dict_unified WHERE is_terminal)""")
def catalogue_texts(s, d):
    x = t(s, d, "occ_dict_unified").filter("is_terminal")
    part = lambda c: F.nullif(c, F.lit(""))
    return x.select("code", X.code_parent(F.col("code"), 2).alias("code_parent"), F.size("task_list").cast("bigint").alias("n_tasks"), F.concat_ws(" > ", part(F.col("occupation_major_category")), part(F.col("occupation_middle_category")), part(F.trim("title"))).alias("hierarchy"))
