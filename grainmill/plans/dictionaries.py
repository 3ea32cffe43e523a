"""Queries over titles, catalogues, rules and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import dictionaries as D
from grainmill.operators import relational as R
from grainmill.operators import rules as L
from grainmill.operators import skills
from grainmill.operators import titles as T
from grainmill.operators.retrieval import tokens
from grainmill.plans.textual import _ITEMS, JOBS, TOKENS_SQL, _items
from grainmill.sources.shared import cut
from grainmill.sources.tables import table as t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TASKS = "label_studio_tasks_v2"
OCC = "occ_dict_unified"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


_BLANK = r"[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+"
_TRIM = f"regexp_replace({{c}}, '^{_BLANK}|{_BLANK}$', '', 'g')"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ").replace("'", "''").replace("{", "{{").replace("}", "}}")
_PLAIN = rf"regexp_replace(lower(translate(coalesce({{c}}, ''), '{_WIDE}', '{_NARROW}')), '[^\p{{{{L}}}}\p{{{{M}}}}\p{{{{Nd}}}}\p{{{{Nl}}}}]', '', 'g')"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({c}) - 1, 1) + 1), lambda i: substring({c}, i, 2)))"
_TOKENS = TOKENS_SQL

FUNCTION, OBJECT = ["经理", "专员", "工程师", "主管", "讲师", "采购员", "协调员"], ["电池", "纺织", "客户", "食品", "网络", "建筑", "汽车", "影视"]
GENERIC, DOMAIN = ["经理", "主管", "专员", "助理"], ["新能源", "电商", "物流", "教育", "医疗"]
LISTS = {"function": FUNCTION, "object": OBJECT, "generic": GENERIC, "domain": DOMAIN}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"SELECT CASE WHEN {_TRIM.format(c='job_title')} IS NULL OR {_TRIM.format(c='job_title')} = '' THEN true ELSE regexp_matches(job_title, '[A-Za-z]{{2,}}[0-9]{{2,}}|[/|_]{{2,}}|\\([^)]{{8,}}\\)|（[^）]{{8,}}）') END AS noisy, count(*) AS n FROM {JOBS} GROUP BY 1")
def noisy_titles(s, d):
    return t(s, d, JOBS, "job_title").groupBy(T.noisy_title(F.col("job_title")).alias("noisy")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT job_title, array_to_string(list_filter({_list(FUNCTION)}, lambda x: contains(job_title, x)), ',') AS functions, array_to_string(list_filter({_list(OBJECT)}, lambda x: contains(job_title, x)), ',') AS objects FROM {JOBS} WHERE job_title IS NOT NULL")
def title_features(s, d):
    f = T.term_features(F.col("job_title"), F.lit(None).cast("string"), {"function": FUNCTION, "object": OBJECT})
    return t(s, d, JOBS, "job_title").filter("job_title IS NOT NULL").distinct().withColumn("f", f).select("job_title", F.array_join("f.function", ",").alias("functions"), F.array_join("f.object", ",").alias("objects"))


_SENT = rf"list_filter(list_transform(string_split_regex(coalesce(text, ''), '[。！？!?;；\n]+'), lambda x: {_TRIM.format(c=r'''regexp_replace(x, '^\s*[0-9]+[.、]\s*', '')''')}), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_SENT}) AS n_sentences, len(list_filter({_SENT}, lambda x: regexp_matches(x, '{'|'.join(T.ACTION_VERBS)}'))) AS n_core, array_to_string(list_filter({_list(DOMAIN)}, lambda x: contains(coalesce(text, ''), x)), ',') AS keywords FROM documents")
def description_features(s, d):
    """Sentences, those with an action verb, and domain words of every text."""
    x = t(s, d, "documents", "doc_id", "text").withColumn("d", T.described(F.col("text"), domains=DOMAIN))
    return x.select("doc_id", F.size("d.sentences").cast("bigint").alias("n_sentences"), F.size("d.core").cast("bigint").alias("n_core"), F.array_join("d.keywords", ",").alias("keywords"))


def _catalogue(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, OCC).filter("is_terminal").select("code", F.trim(F.coalesce("title_clean", "title")).alias("title"), "aliases", F.col("task_list").alias("tasks"), F.col("desc_clean").alias("description"), F.col("occupation_major_category").alias("major"))


_WORDS = "list_distinct(regexp_extract_all(lower({c}), '[a-z]+|[一-龥]+'))"


@query(f"""WITH q AS (SELECT *, {_GRAMS.format(c='tn')} AS tg, {_WORDS.format(c='t')} AS tw FROM (SELECT DISTINCT job_title AS t, {_PLAIN.format(c='job_title')} AS tn FROM {TASKS} WHERE job_title IS NOT NULL) WHERE tn <> ''), e AS (SELECT DISTINCT *, {_GRAMS.format(c='nn')} AS ng, {_WORDS.format(c='name')} AS nw FROM (SELECT code, name, {_PLAIN.format(c='name')} AS nn FROM (SELECT code, unnest(list_concat([trim(coalesce(title_clean, title), ' ')], coalesce(aliases, []))) AS name FROM {OCC} WHERE is_terminal)) WHERE nn <> ''),
x AS (SELECT t, code, name, round(greatest(CASE WHEN nn = tn THEN 1.0 WHEN contains(tn, nn) THEN 0.93 WHEN contains(nn, tn) THEN 0.88 ELSE 0.0 END, coalesce(len(list_intersect(tw, nw)) / nullif(greatest(len(tw), len(nw)), 0), 0.0), len(list_intersect(tg, ng)) / len(list_distinct(list_concat(tg, ng)))), 4) AS score FROM q, e),
b AS (SELECT *, row_number() OVER (PARTITION BY t, code ORDER BY score DESC, name) AS r FROM x WHERE score > 0) SELECT t AS job_title, code, name, score FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, code) AS rn FROM b WHERE r = 1) WHERE rn <= 8""")
def dictionary_retrieval(s, d):
    e = _catalogue(s, d).withColumn("names", F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return T.dictionary_scores(t(s, d, TASKS, "job_title").filter("job_title IS NOT NULL"), "job_title", e, "code", "names")


@query(f"""WITH q AS (SELECT DISTINCT job_title AS q FROM {TASKS} WHERE job_title IS NOT NULL), qw AS (SELECT q, tok, count(*) AS qtf FROM (SELECT q, unnest({_TOKENS.format(c="regexp_replace(q, '[（(][^）)]*[）)]', '', 'g')")}) AS tok FROM q) GROUP BY 1, 2), c AS (SELECT code, trim(coalesce(title_clean, title), ' ') || ' ' || coalesce(desc_clean, '') AS x FROM {OCC} WHERE is_terminal), dw AS (SELECT code, {_TOKENS.format(c='x')} AS w FROM c), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dw),
p AS (SELECT code, len, tok, count(*) AS tf FROM (SELECT code, len(w) AS len, unnest(w) AS tok FROM dw) GROUP BY 1, 2, 3), f AS (SELECT tok, count(*) AS df FROM p GROUP BY 1), b AS (SELECT q, code, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))) AS s FROM qw JOIN f ON qw.tok = f.tok JOIN p ON p.tok = qw.tok, st GROUP BY 1, 2), bn AS (SELECT q, code, s / max(s) OVER (PARTITION BY q) AS score FROM b),
k AS (SELECT DISTINCT q, code, 0.3 AS score FROM qw JOIN (SELECT code, unnest({_GRAMS.format(c='x')}) AS g FROM c) ON tok = g WHERE regexp_matches(tok, '^[一-鿿]{{2}}$')), u AS (SELECT q, code, round(max(score), 6) AS score FROM (SELECT * FROM bn UNION ALL SELECT * FROM k) GROUP BY 1, 2)
SELECT q AS job_title, code, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, code) AS rn FROM u) WHERE rn <= 20""")
def recall_union(s, d):
    c = _catalogue(s, d).select("code", F.concat("title", F.lit(" "), F.coalesce("description", F.lit(""))).alias("x"))
    return T.union_recall(t(s, d, TASKS, "job_title"), "job_title", c, "code", "x").withColumn("score", F.round("score", 4))


@query()
def title_match(s, d):
    """The whole match pipeline over every text of the validation split: title before the mark, description after it."""
    v = t(s, d, "val_set", "row_id", "text").filter("row_id IS NOT NULL AND text IS NOT NULL").distinct()
    v = v.select("row_id", F.trim(F.substring_index("text", "[SEP]", 1)).alias("title"), F.trim(F.regexp_replace("text", r"^.*?\[SEP\]", "")).alias("jd"))
    words = {"软件": "信息", "数据": "信息", "采购": "商业", "客户": "商业", "护理": "生活", "影视": "生活"}
    return T.match_titles(v, "row_id", "title", "jd", _catalogue(s, d), LISTS, words, {"导购": "商品营业员"}, [("房地产|楼盘|置业", ["选品", "广告投放"]), ("电商|跨境|网店", ["楼盘", "房源"])]).withColumn("flags", F.array_join("flags", ","))


@query()
def title_tiers(s, d):
    """Every distinct title by the first tier that holds: equal to an official title (100), the longest contained one (95), the best token-set ratio."""
    j = t(s, d, JOBS).select(F.trim("job_title").alias("title")).filter("title <> ''").distinct()
    o = _catalogue(s, d).groupBy(F.col("title").alias("name")).agg(F.min("code").alias("code"))
    e = j.join(o, j["title"] == o["name"]).select("title", "code", F.lit(100.0).alias("score"))
    rest = j.join(e.select("title"), "title", "left_anti")
    c = skills.contained_terms(rest, "title", "title", o, "name").join(o.select(F.lower("name").alias("term"), "name", "code"), "term")
    c = R.first_per_key(c, ["title"], [F.length("name").desc(), F.col("code")]).select("title", "code", F.lit(95.0).alias("score"))
    last = rest.join(c.select("title"), "title", "left_anti")
    # titles without a pair of characters in common with an official one have no token in common either
    spaced = lambda x: F.array_join(F.array_distinct(tokens(x)), " ")
    met = last.select("title", F.explode(F.array_distinct(tokens(F.col("title")))).alias("w")).join(o.select("name", "code", F.explode(F.array_distinct(tokens(F.col("name")))).alias("w")), "w").select("title", "name", "code").distinct()
    r = cut(met.withColumns({"a": spaced(F.col("title")), "b": spaced(F.col("name"))}))
    r = r.select("title", "code", F.round(T.token_set_ratio("a", "b"), 4).alias("score"))
    return e.unionByName(c).unionByName(R.first_per_key(r, ["title"], [F.desc("score"), F.col("code")]).select("title", "code", "score"))


@query()
def similar_titles(s, d):
    """Official titles whose string ratio is 0.70 or more, in groups: the pairs joined to components."""
    from grainmill.operators.graph import components

    x = _catalogue(s, d)
    return components(T.similar_names(x, "code", "title").select("x", "y"), x.select(F.col("code").alias("id"))).withColumnRenamed("id", "code")


_RULES = [(1, "extract", "certificate", "证书", "持证", None, 10, True, None), (2, "extract", "language", "英语", None, "allow", 20, True, None), (3, "extract", "attitude", "责任心", "责任心", "", 0, True, None), (4, "extract", "off", "能力", None, None, 5, False, None), (5, "template_noise", None, "五险一金", None, None, 10, True, "platform phrase"), (6, "template_noise", None, "优先", None, None, 20, None, "generic"), (7, "template_noise", None, "完成", None, None, None, True, None), (8, "normalize", None, " ", None, None, 1, True, None)]


def _rules(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_RULES, "id int, rule_type string, dimension_name string, pattern_text string, normalized_value string, operator string, priority int, enabled boolean, notes string")


def _sql_value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


_RULE_SQL = "r(id, rule_type, dimension_name, pattern_text, normalized_value, operator, priority, enabled, notes) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in _RULES) + "), a AS (SELECT id, rule_type, dimension_name, trim(pattern_text) AS pattern_text, normalized_value, operator, coalesce(nullif(priority, 0), 100) AS priority, notes FROM r WHERE coalesce(enabled, true) AND trim(pattern_text) <> '')"


@query(f"WITH {_RULE_SQL} SELECT id, rule_type, priority FROM a")
def rules_in_order(s, d):
    return L.active(_rules(s)).select("id", "rule_type", "priority")


_DIST = f"i AS (SELECT DISTINCT recruitment_record_id, unnest({_ITEMS}) AS item FROM {JOBS})"


@query(f"WITH {_RULE_SQL}, {_DIST} SELECT recruitment_record_id, id AS rule_id, dimension_name AS dimension, CASE WHEN dimension_name IN ('certificate', 'language') THEN 'hard_gate' ELSE 'binary' END AS constraint_type, coalesce(nullif(normalized_value, ''), pattern_text) AS value, coalesce(nullif(operator, ''), 'contains') AS operator, count(*) AS n FROM i JOIN a ON a.rule_type = 'extract' AND contains(lower(item), pattern_text) GROUP BY ALL")
def rule_constraints(s, d):
    x = _items(s, d).select("recruitment_record_id", F.explode("items").alias("item")).distinct()
    return L.extracted(x, "item", _rules(s)).groupBy("recruitment_record_id", "rule_id", "dimension", "constraint_type", "value", "operator").agg(F.count("*").alias("n"))


@query(f"WITH {_RULE_SQL}, {_DIST} SELECT id AS rule_id, pattern_text AS noise_text, CASE WHEN contains(coalesce(notes, ''), 'generic') THEN 'generic_token' WHEN contains(coalesce(notes, ''), 'platform') THEN 'platform_phrase' ELSE 'template_phrase' END AS noise_type, count(*) AS n_items, count(DISTINCT recruitment_record_id) AS n_records FROM i JOIN a ON a.rule_type = 'template_noise' AND contains(lower(item), pattern_text) GROUP BY ALL")
def template_noise(s, d):
    x = _items(s, d).select("recruitment_record_id", F.explode("items").alias("item")).distinct()
    return L.template_noise(x, "item", _rules(s)).groupBy("rule_id", "noise_text", "noise_type").agg(F.count("*").alias("n_items"), F.countDistinct("recruitment_record_id").alias("n_records"))


_SKILLS = [("Python", "tool", None), ("Python", "tool", "py"), ("SQL", "tool", "mysql"), ("数据能力", "soft", "数据核对"), ("数据能力", "soft", "样本抽查"), ("合规", "method", "合规检查"), ("风险", "method", "风险排查"), ("风险", "method", "排查"), ("X", "odd", None), ("沟通", "soft", "沟通能力")]


def _skills(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_SKILLS, "name string, category string, alias string")


_SKILL_SQL = "s(name, category, alias) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in _SKILLS) + ")"


@query(f"WITH {_SKILL_SQL}, u AS (SELECT lower(trim(name)) AS term, name, category, false AS is_alias FROM s UNION ALL SELECT lower(trim(alias)), name, category, true FROM s WHERE alias IS NOT NULL), f AS (SELECT DISTINCT * FROM u WHERE term NOT IN ('合规') AND NOT (is_alias AND term = '排查') AND length(term) >= 2) SELECT term, name, category, is_alias, CAST(length(term) AS INTEGER) AS size FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY is_alias, name, category) AS rn FROM f) WHERE rn = 1")
def dictionary_index(s, d):
    return D.term_index(_skills(s), ["合规"], ["排查"])


@query(f"""WITH f AS (SELECT doc_id, text, term FROM documents, (SELECT unnest(['数据核对', '样本抽查', '合规检查', '风险排查']) AS term) WHERE contains(lower(text), term)) SELECT term, count(*) AS n FROM f WHERE term NOT IN ('合规检查', '样本抽查') OR (term = '合规检查' AND (regexp_matches(text, '流程') AND NOT regexp_matches(text, '搭建'))) OR (term = '样本抽查' AND (regexp_matches(text, '负责|从事') OR NOT regexp_matches(text, '培训'))) GROUP BY 1""")
def terms_in_context(s, d):
    """Found terms whose context rules pass."""
    x = t(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    terms = s.createDataFrame([(w,) for w in ("数据核对", "样本抽查", "合规检查", "风险排查")], "term string")
    rules = s.createDataFrame([("合规检查", "流程", "搭建"), ("样本抽查", "负责|从事", None), ("样本抽查", None, "培训")], "term string, require string, reject string")
    f = skills.contained_terms(x.withColumn("k", F.col("doc_id")), "k", "text", terms, "term").withColumnRenamed("k", "doc_id").join(x, "doc_id")
    return D.context_kept(f, "term", "text", rules).groupBy("term").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT doc_id, 'text' AS field, unnest(['数据核对', '样本抽查', '合规检查', '风险排查', '排查']) AS term, lower(text) AS x FROM documents UNION ALL SELECT doc_id, 'company_name', unnest(['科技', '贸易']), lower(company_name) FROM documents), m AS (SELECT doc_id, field, term FROM i WHERE contains(x, term)),
k AS (SELECT * FROM m WHERE NOT (term = '排查' AND NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = m.doc_id AND i.field = 'text' AND i.term = '风险排查' AND contains(replace(i.x, '风险排查', '#'), '排查')))) SELECT doc_id, field, array_to_string(list_sort(list(DISTINCT term)), ',') AS terms FROM k GROUP BY 1, 2""")
def field_matches(s, d):
    """Terms by row and field; a term inside a longer one found with it is none."""
    x = t(s, d, "documents", "doc_id", "text", "company_name")
    a = D.matched_rows(x, "doc_id", ["text"], ["数据核对", "样本抽查", "合规检查", "风险排查", "排查"])
    b = D.matched_rows(x, "doc_id", ["company_name"], ["科技", "贸易"])
    return a.unionByName(b).select("doc_id", "field", F.array_join("terms", ",").alias("terms"))


_SOFT = [("责任心", "attitude", None), ("责任心", "attitude", "责任感"), ("沟通", "people", "沟通能力"), ("协作", "people", "团队合作"), ("细致", "attitude", "耐心细致"), ("诚信", "attitude", "诚信意识")]


@query("WITH s(name, dimension, alias) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in _SOFT) + "), u AS (SELECT DISTINCT name, dimension, term, confidence FROM (SELECT name, dimension, name AS term, 0.9 AS confidence FROM s UNION ALL SELECT name, dimension, alias, 0.85 FROM s WHERE alias IS NOT NULL) WHERE term <> '沟通'), h AS (SELECT doc_id, name, dimension, CAST(confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY doc_id, name ORDER BY length(term) DESC, dimension) AS rn FROM documents, u WHERE contains(text, term)) SELECT name, dimension, confidence, count(*) AS n FROM h WHERE rn = 1 GROUP BY ALL")
def soft_skill_hits(s, d):
    e = s.createDataFrame(_SOFT, "name string, dimension string, alias string")
    x = D.soft_skills(t(s, d, "documents", "doc_id", "text"), "doc_id", "text", e, ["沟通"])
    return x.groupBy("name", "dimension", "confidence").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_SKILL_SQL}, e(a, b) AS (VALUES ('风险', '合规'), ('合规', '数据能力'), ('Python', 'none')), n AS (SELECT DISTINCT name FROM s), l AS (SELECT a, b FROM e WHERE a IN (SELECT name FROM n) AND b IN (SELECT name FROM n)), g AS (SELECT name AS id, name AS root FROM n UNION SELECT CASE WHEN g.id = l.a THEN l.b ELSE l.a END, g.root FROM g JOIN l ON g.id = l.a OR g.id = l.b), c AS (SELECT id AS name, min(root) AS top FROM g GROUP BY 1), x AS (SELECT top, c.name, category, alias FROM s JOIN c USING (name)),
k AS (SELECT top, min_by(category, name) AS category FROM x GROUP BY 1), al AS (SELECT DISTINCT top, unnest([name, alias]) AS alias FROM x) SELECT k.top AS name, category, al.alias FROM k LEFT JOIN (SELECT * FROM al WHERE alias IS NOT NULL AND alias <> top) al ON al.top = k.top""")
def dictionary_merged(s, d):
    return D.merged(_skills(s), s.createDataFrame([("风险", "合规"), ("合规", "数据能力"), ("Python", "none")], "a string, b string"))


@query(f"SELECT name, {_TRIM.format(c='lower(name)')} AS plain FROM (SELECT DISTINCT title AS name FROM {OCC} WHERE title IS NOT NULL)")
def lexicon_forms(s, d):
    return t(s, d, OCC).filter("title IS NOT NULL").select(F.col("title").alias("name")).distinct().select("name", L.lexicon_form(F.col("name")).alias("plain"))


_CAT = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{c}'" for c, p in L.CATEGORIES) + " WHEN node_type = '专业知识' THEN 'process' END"


@query(f"SELECT coalesce({_CAT}, '') AS category, count(*) AS n FROM {OCC} GROUP BY 1")
def skill_categories(s, d):
    x = t(s, d, OCC).select(F.coalesce(L.skill_category(F.col("title"), F.col("node_type")), F.lit("")).alias("category"))
    return x.groupBy("category").agg(F.count("*").alias("n"))


_NOISE, _CERT, _TRAIT, _ENDS = ["双休", "面议"], ["证书", "资格"], ["沟通", "责任", "客户"], ["工程师", "专员", "讲师"]


@query(f"SELECT term_type, category, count(*) AS n FROM (SELECT CASE WHEN x = '' OR x IN ('双休', '面议') OR regexp_matches(x, '本科|大专|硕士|博士|中专|高中|学历|应届') OR regexp_matches(x, '(?:工程师|专员|讲师)$') THEN ['noise_term', 'noise'] WHEN regexp_matches(x, '证书|资格') THEN ['certificate_hint', 'certificate'] WHEN regexp_matches(x, '沟通|责任|客户') THEN ['soft_skill_hint', 'soft_trait'] WHEN regexp_matches(x, '[a-z]') THEN ['tool_hint', 'tool'] ELSE ['hard_skill_hint', 'skill'] END AS k, k[1] AS term_type, k[2] AS category FROM (SELECT {_TRIM.format(c='lower(title)')} AS x FROM {OCC} WHERE title IS NOT NULL)) GROUP BY 1, 2")
def term_types(s, d):
    x = t(s, d, OCC).filter("title IS NOT NULL").select(L.term_type(F.col("title"), _NOISE, _CERT, _TRAIT, _ENDS).alias("k")).select("k.*")
    return x.groupBy("term_type", "category").agg(F.count("*").alias("n"))


@query()
def requirement_layout(s, d):
    """Descriptions laid out line by line, as digests and line counts."""
    x = t(s, d, JOBS, "recruitment_record_id", "job_description_raw").withColumn("x", L.requirement_lines(F.col("job_description_raw")))
    return x.select("recruitment_record_id", F.md5("x").alias("digest"), F.regexp_count("x", F.lit("\n")).alias("n_breaks")).distinct()


@query()
def rule_entity_counts(s, d):
    """Entities by rules in every text: titles of the catalogue, listed skills, and words cased like technologies."""
    titles = [r["title"] for r in _catalogue(s, d).select("title").distinct().collect()]  # the catalogue
    x = t(s, d, "documents", "doc_id", "text").select("doc_id", F.explode(D.rule_entities(titles, ["数据核对", "样本抽查", "合规检查", "风险排查"])(F.col("text"))).alias("e"))
    return x.groupBy("e.label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
