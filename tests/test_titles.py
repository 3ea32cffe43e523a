"""Titles, rules and dictionaries against brute force and small cases."""

import itertools
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from grainmill.operators import dictionaries as D
from grainmill.operators import rules as L
from grainmill.operators import titles as T


def one(spark, f, *v):
    return spark.createDataFrame([v], ", ".join(f"v{i} string" for i in range(len(v)))).select(f(*[F.col(f"v{i}") for i in range(len(v))]).alias("o")).head()["o"]


def test_title_forms(spark):
    assert one(spark, T.light_title, "急聘【深圳】软件-工程师（双休）8k-12k 2024") == "软件 工程师" and one(spark, T.light_title, None) == ""
    assert [one(spark, T.noisy_title, v) for v in (None, " ", "ABC123", "销售//|岗", "会计")] == [True, True, True, True, False]
    assert tuple(one(spark, T.title_label, "焊工(L/S)")) == ("焊工", "L/S") and tuple(one(spark, T.title_label, "护士L")) == ("护士", "L")
    d = one(spark, lambda c: T.described(c, domains=["电商"]), "1、负责电商运营。要求本科；2. 协助直播")
    assert (d["sentences"], d["core"], d["keywords"]) == (["负责电商运营", "要求本科", "协助直播"], ["负责电商运营", "协助直播"], ["电商"])
    assert one(spark, lambda c: T.described(c), None)["sentences"] == []


def test_match_levels(spark):
    df = spark.createDataFrame([("软件 工程师", ["软件工程师"]), ("软件工程师", ["软件工程师"]), ("软件工程帅", ["软件工程师"]), ("厨师", ["护士"]), (None, ["x"]), ("a", [])], "t string, n array<string>")
    assert [r["m"]["level"] for r in df.select(T.match_level("t", "n").alias("m")).collect()] == ["normalized_exact", "exact", "none", "none", "none", "none"]
    assert one(spark, T.token_set_ratio, "a b c", "c b a d") == 100.0 and one(spark, T.token_set_ratio, "", "x") == 0.0


def test_similar_names_against_brute_force(spark):
    rnd = random.Random(4)
    names = [(i, "".join(rnd.choices("甲乙丙丁戊", k=rnd.randint(1, 9)))) for i in range(90)] + [(200, None), (201, ""), (202, "甲乙丙")]
    got = {(r["x"], r["y"]): r["ratio"] for r in T.similar_names(spark.createDataFrame(names, "id int, s string"), "id", "s").collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations([n for n in names if n[1]], 2):
        r = max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
        if r >= 0.70 - 1e-12:
            want[i, j] = round(r, 6)
    assert got == want and len(want) > 20


CATALOGUE = [
    ("c1", "软件测试工程师", ["测试员"], ["负责软件测试用例设计", "跟踪缺陷"], "测试软件质量", "信息类"), ("c2", "房地产销售员", [], ["负责楼盘接待"], "房地产销售", "商业类"),
    ("c3", "电商运营专员", ["网店运营"], ["负责店铺运营与广告投放"], "电商平台运营", "商业类"), ("c4", " ", [], [], None, "信息类"), ("c5", "经理", [], ["制定计划"], "管理", "商业类"),
]
JOBS = [("j1", "软件测试工程师", "负责软件测试用例设计。跟踪缺陷修复"), ("j2", "测试员", "负责软件测试"), ("j3", "销售经理", "负责楼盘接待，选品与广告投放"), ("j4", "zzz", "qqq"), ("j5", None, None), ("j1", "软件测试工程师", "负责软件测试用例设计。跟踪缺陷修复")]


def test_match_pipeline(spark):
    cat = spark.createDataFrame(CATALOGUE, "code string, title string, aliases array<string>, tasks array<string>, description string, major string")
    jobs = spark.createDataFrame([(*j, "x", 1.0) for j in JOBS], "job string, title string, jd string, code string, score double")
    lists = {"function": ["经理"], "object": ["软件"], "generic": ["经理"], "domain": ["电商"]}
    got = T.match_titles(jobs, "job", "title", "jd", cat, lists, {"软件": "信息", "nothing": "none"}, {"店长": "电商运营专员"}, [("房地产|楼盘", ["选品", "广告投放"])]).collect()
    first = {r["job"]: r for r in got if r["place"] <= 1}
    assert set(first) == {"j1", "j2", "j3", "j4", "j5"} and len([r for r in got if r["job"] == "j1" and r["place"] == 1]) == 1
    # title and task routes, the class and both bonuses: 0.45 + 0.30 + 0.15 + 0.10 (equal values count as 1) + 0.10 + 0.18 + 0.08
    assert (first["j1"]["code"], first["j1"]["level"], first["j1"]["score"], first["j1"]["confidence"]) == ("c1", "exact", 1.36, "high")
    assert first["j2"]["code"] == "c1" and first["j2"]["level"] == "exact"
    house = next(r for r in got if r["job"] == "j3" and r["code"] == "c2")
    assert first["j3"]["code"] != "" and "generic_title_penalty" in first["j3"]["flags"] and house["score"] < 1
    for j in ("j4", "j5"):
        assert (first[j]["place"], first[j]["code"], first[j]["flags"], first[j]["confidence"]) == (0, "", ["no_candidates"], "low")
    assert T.match_titles(jobs.limit(0), "job", "title", "jd", cat, lists, {}).count() == 0


def test_rules(spark):
    rules = spark.createDataFrame([(1, "extract", "certificate", "CPA  证", "注会", None, 2, True, None), (2, "extract", "x", "加班", None, "exclude", 1, None, None), (3, "extract", "x", "加班", None, None, 1, False, None), (4, "template_noise", None, "优先", None, None, 1, True, "Generic")], "id int, rule_type string, dimension_name string, pattern_text string, normalized_value string, operator string, priority int, enabled boolean, notes string")
    items = spark.createDataFrame([("r1", "持有cpa 证者优先"), ("r2", "可加班"), ("r3", None), ("r4", ""), ("r1", "持有cpa 证者优先")], "rid string, item string")
    got = {(r["rid"], r["rule_id"], r["dimension"], r["constraint_type"], r["value"], r["operator"]) for r in L.extracted(items, "item", rules).collect()}
    assert got == {("r1", 1, "certificate", "hard_gate", "注会", "contains"), ("r2", 2, "x", "binary", "加班", "exclude")}
    assert {(r["rid"], r["noise_type"]) for r in L.template_noise(items, "item", rules).collect()} == {("r1", "generic_token")}
    assert L.extracted(items, "item", rules.limit(0)).count() == 0


def test_spellings(spark):
    assert one(spark, L.requirement_lines, "任职要求：1、本科；2、会 Excel | 3、细心") == "任职要求：\n1、本科；\n2、会 Excel |\n3、细心" and one(spark, L.requirement_lines, None) == ""
    assert [one(spark, L.skill_key, v) for v in ("  Auto CAD ", "C++ 编程", None)] == ["autocad", "c++ 编程", ""]
    spell = lambda c: L.canonical_alias(c, {"java": "Java", "spring mvc": "Spring MVC"})
    assert [one(spark, spell, v) for v in ("JAVA", "java开发", "Spring  MVC", "Go", None)] == ["Java", "Java", "Spring MVC", "Go", ""]
    assert [one(spark, L.ascii_term, v) for v in ("C++", "3D", "软件", None)] == [True, False, False, False]
    assert [one(spark, lambda c: L.skill_category(c, F.lit("专业知识")), v) for v in ("MySQL数据库", "焊接工艺", "PLC", "沟通")] == ["database", "process", "equipment", "process"]
    assert tuple(one(spark, lambda c: L.term_type(c, ["面议"], ["证书"], ["沟通"], ["工程师"]), "测试工程师")) == ("noise_term", "noise")


def test_dictionaries(spark):
    dic = spark.createDataFrame([("风险", "m", "排查"), ("合规", "m", None), ("Java", "t", "爪哇"), ("Java开发", "t", None), (None, "t", "z")], "name string, category string, alias string")
    m = {(r["name"], r["alias"]) for r in D.merged(dic, spark.createDataFrame([("Java", "Java开发"), ("Java", "none")], "a string, b string")).collect()}
    assert m == {("风险", "排查"), ("合规", None), ("Java", "爪哇"), ("Java", "Java开发")}
    ops = spark.createDataFrame([("drop", "合规", None), ("rename", "风险", "风控"), ("drop_alias", "风险", "排查"), ("add_alias", "java", "JVM"), ("add_alias", "Java开发", "jvm")], "op string, name string, value string")
    c = {(r["name"], r["alias"]) for r in D.corrected(dic.filter("name IS NOT NULL"), ops).collect()}
    assert c == {("风控", None), ("Java", "爪哇"), ("Java", "JVM"), ("Java开发", None)}
    x = spark.createDataFrame([("会数据分析与数据，SQLs 不算 sql 算",), (None,)], "t string")
    assert [r[0] for r in x.select(D.longest_at(["数据", "数据分析", "分析", "SQL"])("t")).collect()] == [["数据分析", "分析", "数据", "sql"], []]
    e = x.select(D.rule_entities(["分析"], ["数据分析", "数据"])("t").alias("e")).head()["e"]
    assert [(s["label"], s["text"]) for s in e] == [("TITLE", "分析"), ("SKILL", "数据")]  # the longer skill overlaps the title
    ok = spark.createDataFrame([("用SQL查询", [(1, 4, "T", "SQL"), (1, 3, "T", "SQ"), (0, 9, "T", "x"), (4, 6, "S", "查询")])], "t string, e array<struct<start:int,end:int,label:string,text:string>>")
    assert [x["text"] for x in ok.select(D.valid_entities(F.col("e"), F.col("t")).alias("e")).head()["e"]] == ["SQL", "查询"]
    tags = spark.createDataFrame([(list("abcde"), ["I-X", "I-X", "B-X", "O", "I-Y"]), ([], [])], "w array<string>, g array<string>")
    assert [[tuple(s) for s in r[0]] for r in tags.select(D.decoded(F.col("w"), F.col("g"))).collect()] == [[(0, 2, "X"), (2, 3, "X"), (4, 5, "Y")], []]
    soft = spark.createDataFrame([("诚信", "a", "诚信意识"), ("沟通", "p", None)], "name string, dimension string, alias string")
    t = spark.createDataFrame([(1, "有诚信意识，善沟通"), (2, None), (3, "诚信")], "id int, text string")
    assert {(r["id"], r["name"], r["confidence"]) for r in D.soft_skills(t, "id", "text", soft, [], spark.createDataFrame([("沟通",)], "name string")).collect()} == {(1, "诚信", 0.85), (3, "诚信", 0.9)}
