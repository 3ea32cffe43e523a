import pytest
from pyspark.sql import functions as F

from grainmill.operators import candidates as C


@pytest.mark.parametrize(
    ("text", "want"),
    [('<think>x</think>```json\n{"a": 1,}\n```', '{"a":1}'), ("answer: {'a': True, 'b': None}", '{"a":true,"b":null}'), ('[{"id": 1}, {"id": 2', '[{"id":1},{"id":2}]'), ('{"a": "cut of', '{"a":"cut of"}'), ("none here", None), ("", None), (None, None)],
)
def test_lenient_json(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.lenient_json(F.col("t")).alias("j")).head()["j"] == want


def test_rerank_and_supplement(spark):
    base = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.5), ("q", "c", 0.1), ("r", "a", 1.0)], "q string, code string, score double")
    order = lambda j: [(r["code"], r["fell_back"]) for r in C.rerank_merge(base, spark.createDataFrame(j, "q string, code string, score double"), "q", "code").filter("q = 'q'").orderBy("place").collect()]
    assert order([("q", "b", 0.7), ("q", "a", 0.6), ("q", "zz", 0.99)]) == [("b", False), ("a", False), ("c", False)]
    assert order([("q", "b", 0.95)]) == [("a", True), ("b", True), ("c", True)]
    assert order([("q", "b", 0.2)])[0] == ("a", True) and order([])[0] == ("a", False)
    got = C.supplement([base.filter("code = 'c'"), base], "q", "code", "score", 2, base.filter("code = 'b'").select("code")).orderBy("q", "slot").collect()
    assert [(r["q"], r["code"], r["slot"]) for r in got] == [("q", "c", 1), ("q", "a", 2), ("r", "a", 1)]


def test_validation_and_precedence(spark):
    f = spark.createDataFrame([(1, "a", "d", 0.85), (1, "b", "d", 0.85), (1, "c", "d", 0.85)], "k int, name string, dimension string, confidence double")
    v = spark.createDataFrame([(1, "a", True, "e"), (1, "b", False, None)], "k int, name string, is_valid boolean, dimension string")
    assert {(r["name"], r["dimension"], r["confidence"], r["source"]) for r in C.validated(f, v, "k", "name").collect()} == {("a", "e", 0.9, "confirmed"), ("c", "d", 0.5, "unconfirmed")}
    assert {r["source"] for r in C.validated(f, None, "k", "name").collect()} == {"fallback"}
    soft = spark.createDataFrame([(1, "SQL"), (1, "耐心")], "k int, name string")
    assert {tuple(r) for r in C.hard_over_soft(soft.limit(1).withColumn("name", F.lower("name")), soft, "k", "name").collect()} == {(1, "sql", "hard"), (1, "耐心", "soft")}


def test_calibration(spark):
    d = spark.createDataFrame([(0.98, "A"), (0.8, "A"), (0.5, "A"), (0.9, "NONE"), (None, "A"), (0.99, None)], "s double, c string")
    assert [r[0] for r in d.select(C.calibrated(F.col("s"), F.col("c"))).collect()] == [0.72, 0.475, 0.25, 0.0, 0.0, 0.0]
    m = spark.createDataFrame([("r", "x", "def", 0.4), ("r", "x", "def", 0.9), ("r", "x", "task", 0.5)], "r string, c string, kind string, s double")
    assert C.fused_max(m, "r", "c", "kind", "s", {"def": 0.6, "task": 0.4}).head()["score"] == pytest.approx(0.74)
