import pytest
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import agreement as A
from grainmill.operators import graph, sections, skills
from grainmill.operators import relational as R
from grainmill.operators import retrieval as V


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).head()["o"]


@pytest.mark.parametrize(("value", "want"), [("3-5年", "1_3_years"), ("无经验", "no_experience_required"), ("1年", "0_1_year"), ("10年以上", "5_10_years"), ("12年", "10_plus_years"), (None, "unknown"), ("", "unknown"), ("若干", "unknown")])
def test_experience(spark, value, want):
    assert one(spark, X.experience_bucket, value) == want


@pytest.mark.parametrize(("value", "want"), [("少于50人", "lt_20"), ("50-150人", "100_499"), ("10000人以上", "10000_plus"), (None, "unknown"), ("20-99人", "20_99")])
def test_size(spark, value, want):
    assert one(spark, X.size_bucket, value) == want


@pytest.mark.parametrize(("value", "want"), [("1-1.5万/月", (10000, 15000)), ("6-9千/月", (6000, 9000)), ("12-24万/年", (10000, 20000)), ("8k-10k", (8000, 10000)), ("面议", None), (None, None)])
def test_salary(spark, value, want):
    got = one(spark, X.salary_range, value)
    assert (got and tuple(got)) == want


def test_city_industry_education(spark):
    assert [one(spark, X.city, v) for v in ("广东省深圳市", "北京", "", None)] == ["深圳", "其他", "未知", "未知"]
    assert [one(spark, X.industry, v) for v in ("互联网/人工智能", None, "电子、机械")] == ["互联网", "未知", "电子"]
    assert [one(spark, X.education, v) for v in ("本科及以上", "学历不限", None, "MBA")] == ["本科", "学历不限", "未明确", "未明确"]


def test_items_and_constraints(spark):
    items = one(spark, X.requirement_items, "熟悉 Office | 本科以上；接受出差")
    assert items == ["熟悉 Office", "本科以上", "接受出差"]
    assert one(spark, X.requirement_items, None) == [] and one(spark, X.requirement_items, "") == []
    plain = one(spark, X.item_plain, "三年 OFFICE经验，性别不限")
    assert "3年" in plain and "Office" in plain and "男女不限" in plain
    facts = lambda v: {(f["dimension"], f["value"], f["operator"]) for f in one(spark, X.item_constraints, v)}
    assert facts("3-5年经验，本科或大专") == {("experience", "3-5年", "between"), ("education", "本科", "ge")}
    assert facts("5年以上工作经验，35岁以下，限女性") == {("experience", "5年", "ge"), ("age", "35岁以下", "le"), ("gender", "女性", "eq")}
    assert facts("年龄22-45岁，男女不限") == {("age", "22-45岁", "between"), ("gender", "不限", "allow")}
    assert facts("吃苦耐劳") == set()


def test_hierarchy(spark):
    d = spark.createDataFrame([("R1-2-3", "R1-2-3"), ("R1-2-3", "R1-2-4"), ("R1-2-3", "R1-9-9"), ("R1-2", "R2-2"), ("A-1", "B-1"), (None, "B")], "a string, b string")
    assert [r[0] for r in d.select(X.hierarchy_distance(F.col("a"), F.col("b"))).collect()] == [0, 1, 2, 3, 4, 4]


def test_upserts(spark):
    old = spark.createDataFrame([("i1", "t", 1, "n1"), ("i2", "t", 2, "")], "id string, tab string, row int, native string")
    new = spark.createDataFrame([("t", 1, "zz"), ("t", 9, "n1"), ("t", 8, ""), ("t", 7, None)], "tab string, row int, native string")
    got = {(r["row"]): r["id"] for r in R.upsert_frozen(old, new, "id", [["tab", "row"], ["native"]], F.concat(F.lit("new"), F.col("row").cast("string"))).collect()}
    assert got == {1: "i1", 9: "i1", 8: "new8", 7: "new7"}
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 6), (3, None, 1)], "k int, v string, w int")
    step = R.conditional_upsert(a, b, ["k"], ["v", "w"])
    assert {r["k"]: r["action"] for r in step.collect()} == {1: "kept", 2: "updated", 3: "inserted"}
    again = R.conditional_upsert(step.drop("action"), b, ["k"], ["v", "w"])
    assert {r["action"] for r in again.collect()} == {"kept"}
    assert R.insert_absent(a, b, ["k"]).count() == 3
    assert R.enriching_merge(a.limit(0), [("b", b)], "k", ["v", "w"]).count() == 3


def test_windows_on_empty_and_nulls(spark):
    e = spark.createDataFrame([], "g string, v int")
    assert R.with_share(e, "v", ["g"]).count() == 0 and R.top_k_per_group(e, ["g"], [F.col("v")], 2).count() == 0
    d = spark.createDataFrame([(None, 1), (None, 3), ("a", 0)], "g string, v int")
    assert {(r["g"], r["share"]) for r in R.with_share(d, "v", ["g"]).collect()} == {(None, 0.25), (None, 0.75), ("a", None)}
    assert {(r["g"], r["n"]) for r in R.min_max(d, "v", ["g"], "n").collect()} == {(None, 0.0), (None, 1.0), ("a", 0.0)}
    assert [r[0] for r in R.top_values(d, "g", 5).collect()] == ["a"]


def test_agreement(spark):
    v = spark.createDataFrame([(1, "p", "A"), (1, "q", "A"), (1, "r", "B"), (2, "p", "B"), (3, "q", None)], "item int, voter string, choice string")
    m = {r["item"]: r for r in A.majority(v, "item", "choice").collect()}
    assert m[1]["choice"] == "A" and m[1]["strict"] and not m[1]["unanimous"] and m[1]["pair_agreement"] == pytest.approx(0.333333) and m[2]["pair_agreement"] is None and 3 not in m
    assert {r["voter"]: r["agreement"] for r in A.voter_quality(v, "item", "voter", "choice").collect()} == {"p": 1.0, "q": 1.0, "r": 0.0}
    s = spark.createDataFrame([(["a", "b"], ["a"]), (None, ["c"])], "p array<string>, g array<string>")
    assert A.set_scores(s, "p", "g").head().asDict() == {"tp": 1, "fp": 1, "fn": 1, "precision": 0.5, "recall": 0.5, "f1": 0.5, "exact_rate": 0.0}


def test_retrieval_against_brute_force(spark):
    import math

    docs = [(1, "red fox"), (2, "red red dog"), (3, None), (4, "dog")]
    d = spark.createDataFrame(docs, "k int, t string").select("k", V.word_tokens(F.col("t")).alias("w"))
    q = spark.createDataFrame([("q", ["red", "dog", "red"])], "q string, qw array<string>")
    got = {r["k"]: r["score"] for r in V.bm25(d, "k", "w", q, "q", "qw").collect()}
    words = {k: (t or "").split() for k, t in docs}
    avg = sum(map(len, words.values())) / 4
    want = {}
    for k, w in words.items():
        s = 0.0
        for x in ["red", "dog", "red"]:
            tf, df = w.count(x), sum(x in y for y in words.values())
            if tf:
                s += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
        if s:
            want[k] = s
    assert got == pytest.approx(want)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0]), (5, None)], "k int, v array<float>")
    top = V.cosine_top_k(v, v, "k", "v", 1, block=2).collect()
    assert {(r["query_key"], r["k"]) for r in top} == {(1, 3), (2, 3), (3, 1)}


def test_components_and_skills(spark):
    n = spark.createDataFrame([(i,) for i in range(8)], "id int")
    e = spark.createDataFrame([(0, 1), (1, 2), (5, 4), (3, 3)], "x int, y int")
    assert {r["id"]: r["component"] for r in graph.components(e, n).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    t = spark.createDataFrame([(1, "用Excel和数据核对"), (2, "excels"), (3, None), (4, "")], "k int, t string")
    assert {r["k"]: r["f"] for r in t.select("k", skills.matcher(["excel", "数据", "数据核对"])("t").alias("f")).collect()} == {1: ["excel", "数据核对"], 2: [], 3: [], 4: []}
    terms = spark.createDataFrame([("数据",), ("数据核对",), ("c",)], "w string")
    assert {tuple(r) for r in skills.contained_terms(t, "k", "t", terms, "w").collect()} == {(1, "数据"), (1, "数据核对"), (1, "c"), (2, "c")}
    tags = spark.createDataFrame([(["a", "b", "c"], [(0, 2, "X")])], "w array<string>, s array<struct<start:int,end:int,label:string>>")
    assert tags.select(skills.bio_tags(F.col("w"), F.col("s"))).head()[0] == ["B-X", "I-X", "O"]


def test_sections(spark):
    texts = ["岗位职责：1、负责销售；2、跟进客户。任职要求：1、本科以上学历；2、两年经验", "<p>福利待遇：五险一金、双休</p>", "负责招聘；协助培训", None, "", "嗯"]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r for r in sections.sectioned(d, "t").collect()}
    assert got[0]["duties_text"] == "负责销售 | 跟进客户。" and got[0]["requirements_text"] == "本科以上学历 | 两年经验" and got[0]["query_source"] == "duties"
    assert got[1]["sections_brief"].startswith("福利待遇") and got[2]["query_source"] == "duties"
    assert got[3]["query_source"] == got[4]["query_source"] == "none" and got[5]["query_source"] == "unclassified"


def test_contained_terms_by_automaton_and_by_join(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "SQL与数据分析"), (1, "数据"), (2, None), (3, ""), (4, "分 析a"), (None, "数据")], "k int, t string")
    terms = spark.createDataFrame([("数据",), ("数据分析",), ("sql",), ("a",), ("",), (None,), ("没有",)], "w string")
    want = {(1, "数据"), (1, "数据分析"), (1, "sql"), (4, "a"), (None, "数据")}
    assert {tuple(r) for r in skills.contained_terms(texts, "k", "t", terms, "w").collect()} == want
    assert skills.contained_terms(texts, "k", "t", terms.limit(0), "w").count() == 0
    monkeypatch.setattr(skills, "FEW", 2)
    assert {tuple(r) for r in skills.contained_terms(texts, "k", "t", terms, "w").collect()} == want
