"""Queries over scalar text functions and reports built on them."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.functions import text as X
from grainmill.operators import relational as R
from grainmill.operators import sections
from grainmill.operators.retrieval import tokens
from grainmill.sources.tables import table as t

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


def _safe(c: str) -> str:
    trimmed = rf"regexp_replace({c}, '^[\s　 ]+|[\s　 ]+$', '', 'g')"
    return f"CASE WHEN {c} IS NULL OR lower({trimmed}) IN ('', 'nan') THEN '' ELSE {trimmed} END"


_CITY = "CASE WHEN c = '' THEN '未知' " + " ".join(f"WHEN contains(c, '{v}') THEN '{v}'" for v in X.GUANGDONG) + " ELSE '其他' END"
_NUMS = r"list_transform(regexp_extract_all({c}, '[0-9]+'), lambda x: CAST(x AS BIGINT))"
_EXP = f"CASE WHEN e = '' THEN 'unknown' WHEN contains(e, '不限') OR contains(e, '无经验') THEN 'no_experience_required' WHEN en IS NULL THEN 'unknown' WHEN en <= 1 THEN '0_1_year' WHEN en <= 3 THEN '1_3_years' WHEN en <= 5 THEN '3_5_years' WHEN en <= 10 THEN '5_10_years' ELSE '10_plus_years' END"
_SIZE = "CASE WHEN z = '' THEN 'unknown' WHEN contains(z, '少于') OR contains(z, '0-20') OR contains(z, '20人以下') THEN 'lt_20' WHEN zn IS NULL THEN 'unknown' WHEN zn < 100 THEN '20_99' WHEN zn < 500 THEN '100_499' WHEN zn < 1000 THEN '500_999' WHEN zn < 10000 THEN '1000_9999' ELSE '10000_plus' END"
_EDU = "CASE WHEN education_requirement_raw IS NULL OR education_requirement_raw = '' THEN '未明确' WHEN contains(education_requirement_raw, '不限') OR contains(education_requirement_raw, '无要求') THEN '学历不限' " + " ".join(f"WHEN contains(education_requirement_raw, '{v}') THEN '{v}'" for v in X.DEGREES) + " ELSE '未明确' END"
_IND = "CASE WHEN i = '' THEN '未知' ELSE i END"
_DIMS = f"""WITH raw AS (SELECT *, {_safe('work_city')} AS c, {_safe('experience_requirement_raw')} AS e, {_safe('company_size_raw')} AS z, trim(string_split_regex({_safe('company_industry_raw')}, '[,，/、]+')[1]) AS i FROM {JOBS}),
n AS (SELECT *, list_min({_NUMS.format(c='e')}) AS en, list_max({_NUMS.format(c='z')}) AS zn FROM raw),
dims AS (SELECT recruitment_record_id, source_platform, source_table, source_row_number, salary_raw, {_CITY} AS city, {_EXP} AS experience, {_SIZE} AS size, {_EDU} AS education, {_IND} AS industry FROM n)"""


def dims(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, JOBS).select("recruitment_record_id", "source_platform", "source_table", "source_row_number", "salary_raw", X.city(F.col("work_city")).alias("city"), X.experience_bucket(F.col("experience_requirement_raw")).alias("experience"), X.size_bucket(F.col("company_size_raw")).alias("size"), X.education(F.col("education_requirement_raw")).alias("education"), X.industry(F.col("company_industry_raw")).alias("industry"))


@query(_DIMS + " SELECT recruitment_record_id, source_table, source_row_number, city, experience, size, education, industry FROM dims")
def dimension_columns(s, d):
    return dims(s, d).drop("source_platform", "salary_raw")


@query(_DIMS + ", g AS (SELECT size, city, industry, count(*) AS n FROM dims GROUP BY 1, 2, 3) SELECT *  FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY size, city), 6) AS share FROM g) WHERE n >= 10")
def size_city_industry_share(s, d):
    g = dims(s, d).groupBy("size", "city", "industry").agg(F.count("*").alias("n"))
    return R.with_share(g, "n", ["size", "city"]).filter("n >= 10")


@query(_DIMS + ", g AS (SELECT city, education, count(*) AS n FROM dims GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY city), 6) AS share FROM g")
def city_education_share(s, d):
    g = dims(s, d).groupBy("city", "education").agg(F.count("*").alias("n"))
    return R.with_share(g, "n", ["city"])


_PATTERNS = " ".join(f"WHEN regexp_matches(s, '{p}') THEN [CAST(regexp_extract(s, '{p}', 1) AS DOUBLE) * {m} / per, CAST(regexp_extract(s, '{p}', 2) AS DOUBLE) * {m} / per]" for p, m in X.SALARY_FORMS)


@query(f"""WITH a AS (SELECT recruitment_record_id, source_table, source_row_number, lower(trim(salary_raw)) AS s, CASE WHEN contains(salary_raw, '年') THEN 12.0 ELSE 1.0 END AS per FROM {JOBS}), b AS (SELECT *, CASE {_PATTERNS} END AS r FROM a)
SELECT recruitment_record_id, source_table, source_row_number, round(r[1], 2) AS low, round(r[2], 2) AS high FROM b""")
def range_parse(s, d):
    x = t(s, d, JOBS, "recruitment_record_id", "source_table", "source_row_number", "salary_raw").withColumn("r", X.salary_range(F.col("salary_raw")))
    return x.select("recruitment_record_id", "source_table", "source_row_number", F.round("r.low", 2).alias("low"), F.round("r.high", 2).alias("high"))


@query(f"""{_DIMS}, a AS (SELECT *, lower(trim(salary_raw)) AS s, CASE WHEN contains(salary_raw, '年') THEN 12.0 ELSE 1.0 END AS per FROM dims), b AS (SELECT education, city, CASE {_PATTERNS} END AS r FROM a)
SELECT education, city, CAST(sum(CAST(round((r[1] + r[2]) * 50) AS BIGINT)) AS BIGINT) AS total_cents, round(median((r[1] + r[2]) / 2), 2) AS median_pay, count(*) AS n FROM b WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""")
def pay_by_education_city(s, d):
    x = dims(s, d).withColumn("r", X.salary_range(F.col("salary_raw"))).filter("r IS NOT NULL").select("education", "city", ((F.col("r.low") + F.col("r.high")) / 2).alias("pay"))
    g = x.groupBy("education", "city").agg(F.sum(F.round(F.col("pay") * 100).cast("bigint")).alias("total_cents"), F.count("*").alias("n")).filter("n >= 5")
    return g.join(R.exact_quantile(x, ["education", "city"], "pay", 0.5, "median_pay").withColumn("median_pay", F.round("median_pay", 2)), ["education", "city"], "left")


def _items(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, JOBS, "recruitment_record_id", "source_table", "source_row_number", "job_description_raw").withColumn("items", X.requirement_items(F.col("job_description_raw")))


_ITEMS = r"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(coalesce(job_description_raw, ''), '\r\n?', chr(10), 'g'), '[•●■▪◆★]+|[;；]+|\n+|(?:^|\s)[（(]?\d+[）).、]', ' | ', 'g'), '\s*\|\s*'), lambda x: regexp_replace(x, '^[ ,，。；;|]+|[ ,，。；;|]+$', '', 'g')), lambda x: x <> '')"""


@query(f"SELECT recruitment_record_id, source_table, source_row_number, CAST(len({_ITEMS}) AS BIGINT) AS n_items, len({_ITEMS}) >= 2 AS reliable FROM {JOBS}")
def item_split_reliability(s, d):
    return _items(s, d).select("recruitment_record_id", "source_table", "source_row_number", F.size("items").cast("bigint").alias("n_items"), X.items_reliable(F.col("items")).alias("reliable"))


@query()
def requirement_constraints(s, d):
    """Constraint facts, each distinct item read once: one row a record, item and constraint."""
    x = _items(s, d).select("recruitment_record_id", F.posexplode("items").alias("item_index", "item")).filter(F.col("item").rlike(r"[年岁级]|不限|限\s*[男女]|高中|中专|大专|本科|硕士|博士")).distinct()
    facts = x.select("item").distinct().withColumn("facts", X.item_constraints(X.item_plain(F.col("item")))).filter(F.size("facts") > 0)
    return x.join(facts, "item").select("recruitment_record_id", "item_index", F.explode("facts").alias("f")).select("recruitment_record_id", "item_index", "f.*").distinct()


@query()
def constraint_frequency(s, d):
    """Records and facts per dimension and operator, with the share of records."""
    f = requirement_constraints(s, d)
    n = t(s, d, JOBS).agg(F.countDistinct("recruitment_record_id").alias("all"))
    g = f.groupBy("dimension", "operator").agg(F.countDistinct("recruitment_record_id").alias("n_records"), F.count("*").alias("n_facts"))
    return g.withColumn("share", F.round(F.col("n_records") / F.greatest(F.lit(1), n.scalar()), 6))


_REQ, _BEN = "学历|专业|经验|优先|熟练|能力|证|年龄|具备|了解", "福利|待遇|补贴|奖金|住宿|五险一金|年假|体检|双休"
_COUNTS = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS n{i}" for i, p in enumerate(sections.WORDS.values()))
_FIRST = "CASE WHEN greatest(n0, n1, n2, n3) = 0 THEN NULL " + " ".join(f"WHEN n{i} = greatest(n0, n1, n2, n3) THEN '{k}'" for i, k in enumerate(sections.WORDS)) + " END"


@query(f"SELECT doc_id, CAST(n0 AS BIGINT) AS duty, CAST(n1 AS BIGINT) AS req, CAST(n2 AS BIGINT) AS ben, {_FIRST} AS section FROM (SELECT doc_id, {_COUNTS} FROM documents)")
def section_inference(s, d):
    n = sections.word_counts(F.col("text"))
    return t(s, d, "documents", "doc_id", "text").select("doc_id", n[0].alias("duty"), n[1].alias("req"), n[2].alias("ben"), sections.inferred(F.col("text")).alias("section"))


_NAMES = "MAP {" + ", ".join(f"'{k}': chr({v})" for k, v in sorted(name2codepoint.items())) + ", 'apos': chr(39)}"
_NAME = "regexp_extract(z, '^(#?[A-Za-z0-9]{1,10});', 1)"
_DECODED = f"CASE WHEN {_NAME} <> '' AND names[{_NAME}] IS NOT NULL THEN names[{_NAME}] || substring(z, length({_NAME}) + 2) WHEN regexp_matches({_NAME}, '^#[0-9]{{1,7}}$') AND TRY_CAST(substring({_NAME}, 2) AS INTEGER) BETWEEN 1 AND 1114111 THEN chr(TRY_CAST(substring({_NAME}, 2) AS INTEGER)) || substring(z, length({_NAME}) + 2) ELSE '&' || z END"
_NO_TAGS = r"regexp_replace(regexp_replace(coalesce(job_description_raw, ''), '(?i)<br[^<>]*>|</(?:p|div|li|ul|ol|tr|table|section|article|h[1-6])[^<>]*>', chr(10), 'g'), '<[^<>]+>', '', 'g')"


@query(f"""WITH n AS (SELECT {_NAMES} AS names), a AS (SELECT recruitment_record_id, source_table, source_row_number, string_split({_NO_TAGS}, '&') AS ps FROM {JOBS}), b AS (SELECT recruitment_record_id, source_table, source_row_number, ps[1] || array_to_string(list_transform(ps[2:], lambda z: {_DECODED}), '') AS x FROM a, n)
SELECT recruitment_record_id, source_table, source_row_number, md5(translate(regexp_replace(x, '</?[A-Za-z][^<>]*>', '', 'g'), '“”‘’', '""''''')) AS digest FROM b""")
def html_strip(s, d):
    """Descriptions without mark-up, as digests of what is left."""
    x = t(s, d, JOBS, "recruitment_record_id", "source_table", "source_row_number", "job_description_raw")
    return x.select("recruitment_record_id", "source_table", "source_row_number", F.md5(X.strip_html(F.col("job_description_raw"))).alias("digest"))


@query(f"""WITH x AS (SELECT *, {_safe('job_title')} AS a, {_safe('company_name')} AS b, {_safe('work_city')} AS c FROM {JOBS}) SELECT recruitment_record_id, source_table, source_row_number, sha1(lower(a) || '||' || lower(b) || '||' || lower(c)) AS digest FROM x""")
def record_fingerprint(s, d):
    return t(s, d, JOBS).select("recruitment_record_id", "source_table", "source_row_number", X.fingerprint(F.col("job_title"), F.col("company_name"), F.col("work_city")).alias("digest"))


@query("""SELECT a.code AS code_a, b.code AS code_b, CASE WHEN a.code = b.code THEN 0 WHEN string_split(a.code, '-')[1:2] = string_split(b.code, '-')[1:2] THEN 1 WHEN string_split(a.code, '-')[1] = string_split(b.code, '-')[1] THEN 2 WHEN a.code[1] = b.code[1] THEN 3 ELSE 4 END AS distance
FROM (SELECT DISTINCT cand_a_code AS code, cand_b_code AS other FROM label_studio_tasks_v2 WHERE cand_a_code <> '' AND cand_b_code <> '') a JOIN (SELECT DISTINCT code FROM occ_dict_unified WHERE is_terminal) b ON a.other = b.code""")
def hierarchy_distance(s, d):
    x = t(s, d, "label_studio_tasks_v2").filter("cand_a_code <> '' AND cand_b_code <> ''").select(F.col("cand_a_code").alias("code_a"), F.col("cand_b_code").alias("code_b")).distinct()
    leaf = t(s, d, "occ_dict_unified").filter("is_terminal").select(F.col("code").alias("code_b")).distinct()
    return x.join(leaf, "code_b").select("code_a", "code_b", X.hierarchy_distance(F.col("code_a"), F.col("code_b")).alias("distance"))


@query()
def description_noise_free(s, d):
    """Descriptions without mark-up and decorative noise, as digests: the look-around of the pattern has no SQL equal."""
    return t(s, d, JOBS).select("recruitment_record_id", F.md5(X.drop_noise(X.strip_html(F.col("job_description_raw")))).alias("digest")).distinct()


@query()
def plain_titles(s, d):
    """Frequency of titles once decorations are off, with a first sample of the raw form."""
    x = t(s, d, JOBS, "job_title").withColumn("plain", X.title_plain(F.col("job_title"))).filter("plain <> ''")
    return x.groupBy("plain").agg(F.count("*").alias("n"), F.min("job_title").alias("sample")).filter("n >= 2")


_RISK = f"(coalesce(job_description_raw, '') = '') OR regexp_matches(job_description_raw, '[。；;]\\s*(岗位职责|任职要求|岗位要求)[:：]') OR (regexp_matches(job_description_raw, '{_BEN}') AND NOT regexp_matches(job_description_raw, '{_REQ}'))"


@query(f"SELECT recruitment_record_id, source_table, source_row_number FROM {JOBS} WHERE {_RISK}")
def risk_rows(s, d):
    c = F.col("job_description_raw")
    risky = (F.coalesce(c, F.lit("")) == "") | c.rlike(r"[。；;]\s*(岗位职责|任职要求|岗位要求)[:：]") | (c.rlike(_BEN) & ~c.rlike(_REQ))
    return t(s, d, JOBS).filter(risky).select("recruitment_record_id", "source_table", "source_row_number")


@query(f"""{_DIMS}, y AS (SELECT d.*, substring(strftime(j.created_at, '%Y-%m'), 1, 7) AS month FROM dims d JOIN {JOBS} j USING (recruitment_record_id, source_table, source_row_number) WHERE j.updated_at = (SELECT max(updated_at) FROM {JOBS} k WHERE k.recruitment_record_id = j.recruitment_record_id)),
g AS (SELECT industry, month, count(DISTINCT recruitment_record_id) AS n FROM y GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER (PARTITION BY industry ORDER BY month) AS previous FROM g WHERE n >= 2)
SELECT industry, month, n, previous, n - previous AS change, round((n - previous) / previous, 6) AS growth FROM l""")
def industry_trend(s, d):
    x = t(s, d, JOBS).select("recruitment_record_id", X.industry(F.col("company_industry_raw")).alias("industry"), F.date_format("created_at", "yyyy-MM").alias("month"))
    g = x.groupBy("industry", "month").agg(F.countDistinct("recruitment_record_id").alias("n")).filter("n >= 2")
    return R.lagged(g, ["industry"], ["month"], "n")


TOKENS_SQL = "list_concat(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9]+'), lambda z: lower(z)), flatten(list_transform(regexp_extract_all(coalesce({c}, ''), '[一-鿿]+'), lambda r: list_transform(range(1, greatest(length(r) - 1, 1) + 1), lambda i: substring(r, i, 2)))))"


@query(f"""WITH w AS (SELECT DISTINCT doc_id, lang, unnest({TOKENS_SQL.format(c='text')}) AS word FROM documents), g AS (SELECT lang, word, count(*) AS n FROM w WHERE lang IS NOT NULL AND regexp_matches(word, '^(?:[a-z]{{3,}}|[一-鿿]{{2}})$') GROUP BY 1, 2), a AS (SELECT word, sum(n) AS total FROM g GROUP BY 1)
SELECT lang, word, n, score FROM (SELECT lang, g.word, n, round(n / total, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY round(n / total, 6) DESC, n DESC, g.word) AS rn FROM g JOIN a ON g.word = a.word WHERE n >= 3) WHERE rn <= 10""")
def keyword_distinctiveness(s, d):
    """Words of three Latin letters or more and pairs of Han characters, by how much they belong to one language's texts."""
    w = t(s, d, "documents", "doc_id", "lang", "text").filter("lang IS NOT NULL").select("doc_id", "lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).filter(F.col("word").rlike(r"^(?:[a-z]{3,}|[一-鿿]{2})$"))
    g = w.groupBy("lang", "word").agg(F.count("*").alias("n"))
    g = g.withColumn("score", F.round(F.col("n") / F.sum("n").over(W.partitionBy("word")), 6)).filter("n >= 3")
    return R.top_k_per_group(g, ["lang"], [F.desc("score"), F.desc("n"), F.col("word")], 10)
