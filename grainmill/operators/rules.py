"""Rules as tables: patterns that texts contain, what they say, and how terms are typed and spelled.

Rules are rows (id, rule_type, dimension_name, pattern_text, normalized_value, operator, priority, enabled, notes); they meet texts by an n-gram join, so
their number is not bounded.  Blank patterns and rules that are off say nothing; NULL and blank texts meet no rule; a rule that a text meets twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.chars import narrow, trim_all
from grainmill.operators.skills import contained_terms

# Dimensions whose rules are conditions that must hold.
GATES = ["certificate", "language"]


def lexicon_form(c: Column) -> Column:
    """Lower case, ordinary width, single blanks; '' for NULL."""
    return F.lower(trim_all(F.regexp_replace(narrow(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")))


def active(rules: DataFrame, kind: str | None = None) -> DataFrame:
    """The rules that are on (NULL counts as on) and have a type and a pattern, with their order: by priority (NULL and 0 as 100), then id."""
    x = rules.filter(F.coalesce("enabled", F.lit(True)) & (F.coalesce(F.trim("rule_type"), F.lit("")) != "") & (F.coalesce(F.trim("pattern_text"), F.lit("")) != ""))
    x = x.withColumns({"rule_type": F.trim("rule_type"), "pattern_text": F.trim("pattern_text"), "priority": F.coalesce(F.nullif("priority", F.lit(0)), F.lit(100))})
    return (x if kind is None else x.filter(F.col("rule_type") == kind)).orderBy("rule_type", "priority", "id")


def _hits(items: DataFrame, item: str, rules: DataFrame) -> DataFrame:
    """Distinct items with the rules whose pattern they contain, both in lexicon form."""
    d = items.select(F.col(item).alias("_item")).distinct().withColumn("_plain", lexicon_form(F.col("_item"))).filter("_plain <> ''")
    r = rules.withColumn("_pattern", lexicon_form(F.col("pattern_text")))
    return contained_terms(d, "_item", "_plain", r.select("_pattern").distinct(), "_pattern").withColumnRenamed("term", "_pattern").join(r, "_pattern").drop("_pattern")


def extracted(items: DataFrame, item: str, rules: DataFrame) -> DataFrame:
    """``items`` with rule_id, dimension, constraint_type, value, operator, evidence of every extraction rule that the item contains."""
    h = _hits(items, item, active(rules, "extract"))
    h = h.select(F.col("_item").alias(item), F.col("id").alias("rule_id"), F.col("dimension_name").alias("dimension"), F.when(F.col("dimension_name").isin(GATES), "hard_gate").otherwise("binary").alias("constraint_type"), F.coalesce(F.nullif(F.trim("normalized_value"), F.lit("")), "pattern_text").alias("value"), F.coalesce(F.nullif(F.trim("operator"), F.lit("")), F.lit("contains")).alias("operator"), F.col("pattern_text").alias("evidence"))
    return items.join(h, item)


def template_noise(items: DataFrame, item: str, rules: DataFrame) -> DataFrame:
    """``items`` with rule_id, noise_type and noise_text of every noise rule that the item contains; the type is in the rule's notes."""
    n = F.lower(F.coalesce("notes", F.lit("")))
    kind = F.when(n.contains("generic"), "generic_token").when(n.contains("platform"), "platform_phrase").otherwise("template_phrase")
    h = _hits(items, item, active(rules, "template_noise")).select(F.col("_item").alias(item), F.col("id").alias("rule_id"), kind.alias("noise_type"), F.col("pattern_text").alias("noise_text"))
    return items.join(h, item)


def folded(c: Column, rules: list[tuple[str, str]]) -> Column:
    """A text with each pattern replaced in turn: the fold of normalisation rules."""
    for pattern, to in rules:
        c = F.replace(c, F.lit(pattern), F.lit(to))
    return c


def requirement_lines(c: Column) -> Column:
    """A requirement text with a line for each part: at bars, semicolons, list numbers, headings and dashes; '' for NULL."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\|\s*", " |\n"), r"\s*[;；]\s*", "；\n")
    t = F.regexp_replace(t, r"(?<!\n)(?<!\d)(?=\d{1,2}[、.．)）]|[-*]\s)|(?<!\n)(?<![一二三四五六七八九十])(?=[一二三四五六七八九十]+[、.．])|(?<!\n)(?=(?:任职要求|岗位职责|工作职责|职位要求|职位描述|福利待遇|任职资格)\s*[:：])", "\n")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), trim_all), lambda x: x != ""), "\n")


def ascii_term(c: Column) -> Column:
    """Whether a term is matched at word boundaries: a letter, then letters, digits and .+#/- only."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9.+#/\-]*$"), F.lit(False))


def canonical_alias(c: Column, spellings: dict[str, str], endings: str = "语言|开发|编程|框架|数据库|技术") -> Column:
    """The spelling that stands for a term (keys in lower case), looked up as it is and without a general ending; else the term, trimmed."""
    t = F.regexp_replace(trim_all(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    known = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(t)), F.try_element_at(known, F.lower(trim_all(F.regexp_replace(t, rf"(?:{endings})$", "")))), t)


def skill_key(c: Column) -> Column:
    """What skills are compared by: lower case, single blanks, none in names of ASCII alone."""
    k = F.lower(trim_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))
    return F.when(k.rlike(r"^[a-z0-9 .+#/\-]+$"), F.replace(k, F.lit(" "), F.lit(""))).otherwise(k)


# What names of skills tell of their category, in the order in which they are tried.
CATEGORIES = [
    ("programming_language", "编程语言|脚本语言"), ("database", "数据库|数据仓库|数据存储|(?i:nosql|newsql)"), ("office", "办公软件|文档处理|表格处理|演示文稿"),
    ("certification", r"证书|资质|认证|资格|执照|牌照|体系|标准|规范|法规|法律|规程|制度|规定|(?i:iso|iatf|gmp|haccp|fda|vda|gb\d|ts\d)"), ("framework", "框架|引擎|(?i:runtime)|运行时"),
    ("equipment", "设备|仪器|仪表|机床|机器人|控制器|传感器|探头|夹具|治具|工装|变频器|伺服|(?i:plc|cnc|dcs|scada|hmi)"), ("process", "工艺|方法|技术|流程|操作|实验|分析|检测|检验|测试|调试|优化|开发|设计|制造|生产|加工"),
]


def skill_category(name: Column, kind: Column, by_name: dict[str, str] | None = None, by_kind: dict[str, str] | None = None) -> Column:
    """The category of a skill: by its whole name, by the first of CATEGORIES that its name tells of, by its kind; NULL where none says."""
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in by_name.items() for x in kv]), name) if by_name else F.lit(None).cast("string")
    told = F.when(F.lit(False), F.lit(""))
    for category, pattern in CATEGORIES:
        told = told.when(name.rlike(pattern), category)
    rest = F.try_element_at(F.create_map(*[F.lit(x) for kv in by_kind.items() for x in kv]), kind) if by_kind else F.lit(None).cast("string")
    return F.coalesce(out, told, rest, F.when(kind == "专业知识", "process"))


def term_type(c: Column, noise: list[str], certificates: list[str], soft: list[str], job_endings: list[str]) -> Column:
    """STRUCT<term_type, category> of a dictionary term: noise (listed, years, degrees, job titles), certificate, soft trait, tool (Latin letters), else skill."""
    t = lexicon_form(c)
    any_of = lambda words: t.rlike("|".join(words)) if words else F.lit(False)
    junk = (t == "") | t.isin([w.lower() for w in noise]) | t.rlike(r"^\d+(?:\s*-\s*\d+)?年(?:以上)?$") | any_of(["本科", "大专", "硕士", "博士", "中专", "高中", "学历", "应届"])
    ends = t.rlike("(?:" + "|".join(job_endings) + ")$") if job_endings else F.lit(False)
    pair = lambda a, b: F.struct(F.lit(a).alias("term_type"), F.lit(b).alias("category"))
    return F.when(junk | ends, pair("noise_term", "noise")).when(any_of(certificates), pair("certificate_hint", "certificate")).when(any_of(soft), pair("soft_skill_hint", "soft_trait")).when(t.rlike("[a-z]"), pair("tool_hint", "tool")).otherwise(pair("hard_skill_hint", "skill"))
