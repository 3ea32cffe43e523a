"""Releases, upserts, files of unusual form, and numbering."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import agreement as A
from grainmill.operators import relational as R
from grainmill.operators import releases as Z
from grainmill.sources import files
from grainmill.streaming import events as E


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_releases(spark):
    rel = spark.createDataFrame([(1, True), (2, False)], "release_id int, is_current boolean")
    res = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "release_id int, term string")
    assert rows(Z.bound(res, rel).select("term")) == [("a",), ("b",)]
    with pytest.raises(Exception, match="current releases: 2"):
        Z.bound(res, rel.withColumn("is_current", F.lit(True))).collect()
    assert rows(Z.stamped(rel, spark.createDataFrame([(2,)], "release_id int"))) == [(1, False), (2, True)]
    assert rows(Z.replaced(res, spark.createDataFrame([(1, "z")], "release_id int, term string"))) == [(1, "z"), (2, "c")]
    assert Z.filled_if_empty(res, res, ["term"]).count() == 3 and Z.filled_if_empty(res.limit(0), res, ["release_id"]).count() == 2


def test_upserts(spark):
    old = spark.createDataFrame([(1, "x", "old"), (None, "n", "old")], "k int, v string, at string")
    got = rows(Z.upsert_latest(old, spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k int, v string"), ["k"], "at", F.lit("now")))
    assert got == [(1, "y", "now"), (2, "z", "now"), (None, "n", "old")]
    base = spark.createDataFrame([(1, ""), (2, "r2"), (3, "")], "id int, rid string")
    audit = spark.createDataFrame([(1, "r1", "unique"), (2, "r9", "review"), (3, "", "unique")], "id int, rid string, status string")
    assert rows(Z.back_propagated(base, audit, "id", "rid", "status", ["unique"])) == [(1, "r1"), (2, "r2"), (3, "")]
    Z.save_table(old, "saved_rows")
    Z.save_table(old, "saved_rows", append=True)
    Z.save_tables({"other_rows": old.limit(1)})
    assert spark.table("saved_rows").count() == 4 and spark.table("other_rows").count() == 1
    spark.sql("DROP TABLE saved_rows"), spark.sql("DROP TABLE other_rows")


def test_numbering_and_guards(spark):
    df = spark.range(0, 500).withColumn("id", (F.col("id") * 7919) % 1000)
    got = [r["row_number"] for r in R.row_numbers(df, ["id"]).orderBy("id").collect()]
    assert got == list(range(1, 501)) and R.row_numbers(df.limit(0), ["id"]).count() == 0
    assert [r[0] for r in spark.range(1, 7).select(R.chunk_of(F.col("id"), 3)).collect()] == [1, 1, 1, 2, 2, 2]
    with pytest.raises(Exception, match="no id"):
        R.guarded(spark.createDataFrame([(1,), (None,)], "id int"), F.col("id") > 0, "no id").collect()
    v = spark.createDataFrame([(1, None, "v9", 1), (1, None, "v10", 2), (2, "b", "v1", 3), (2, "c", "v1", 4)], "k int, at string, version string, n int")
    assert rows(R.latest(v, ["k"], "at", "version").select("n")) == [(2,), (4,)]
    yes, no = R.split_at(spark.createDataFrame([(0.9,), (0.1,), (None,)], "s double"), "s", 0.5)
    assert (yes.count(), no.count()) == (1, 2)


def test_exact_quantiles(spark):
    rng = random.Random(3)
    data = [(g, float(rng.choice([1, 1, 2, 5, 100])) if g == "ties" else rng.gauss(0, 1)) for g in ("a", "ties", None) for _ in range(rng.randint(50, 90))] + [("one", 4.0), ("null", None)]
    df = spark.createDataFrame(data, "g string, v double")
    for q in (0.0, 0.31, 0.5, 0.95, 1.0):
        want = {r["g"]: r["w"] for r in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.lit(q)).alias("w")).collect()}
        got = {r["g"]: r["m"] for r in R.exact_quantile(df, ["g"], "v", q, "m", bins=7).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_json_elements_at_any_chunk_size(spark, tmp_path):
    values = [1, None, 'a"b\\', "[,]{", {"k": [1, {"x": "}"}]}, "中,文", [], {}, ""]
    raw = json.dumps(values, ensure_ascii=False).encode()
    for n in (1, 2, 3, 7, 1000):
        assert [json.loads(x) for x in files.json_elements(io.BytesIO(raw), n)] == values
    assert list(files.json_elements(io.BytesIO(b'[{"a":1},{"a":2},{"a"'), 4)) == ['{"a":1}', '{"a":2}'] and list(files.json_elements(io.BytesIO(b""))) == []
    (tmp_path / "x.json").write_bytes("\ufeff".encode() + json.dumps([{"a": i} for i in range(2500)]).encode())
    got = files.read_json_elements(spark, [f"file://{tmp_path}/x.json"], "struct<a:int>", 64)
    assert got.count() == 2500 and got.filter("a = position").count() == 2500


def test_workbooks_and_plain_configurations(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (None, "中文 ")], "`N o` int, text string")
    files.write_xlsx({"one": df, "two": df.limit(1)}, str(tmp_path / "x.xlsx"))
    got = files.read_xlsx(spark, f"file://{tmp_path}/x.xlsx")
    assert got.columns == ["n_o", "text"] and rows(got) == [("", "中文 "), ("1", "a<b")]
    assert files.simple_yaml("a:\n  b: 1\n  c: 'x: y' # note\nlist:\n- 2.5\n- true\n# comment\nempty:\n") == {"a": {"b": 1, "c": "x: y"}, "list": [2.5, True], "empty": None}
    assert files.simple_yaml("") == {}


def test_marks_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("中", 1)], "name string, n int")
    files.write_csv(df, str(tmp_path / "new"), str(tmp_path / "old"))
    for d in ("new", "old"):
        assert next((tmp_path / d).glob("*.csv")).read_bytes().startswith("\ufeffname".encode())
        assert rows(files.read_csv(spark, f"file://{tmp_path}/{d}", ["name", "n"])) == [("中", "1")]
    assert sum(r["n_rows"] for r in files.write_shards(spark.range(7).coalesce(1), str(tmp_path / "s"), 3).collect()) == 7
    assert files.head_bytes(spark, f"file://{tmp_path}/nothing*") == b""


def test_buckets_of_a_stream(spark, tmp_path):
    mk = lambda r: spark.createDataFrame(r, "id int, at int, v string")
    merge = E.merge_buckets(spark, str(tmp_path / "t"), ["id"], "at", 4)
    for i, b in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (3, 1, "d")], [(1, 3, "c"), (3, 1, "d")], [(1, 2, "late")], [])):
        merge(mk(b), i)
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("id", "v")) == [(1, "c"), (2, "b"), (3, "d")]


def test_entities_and_quantities(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("o")).head()["o"]
    assert one(X.entities, "a &amp; b &nosuch; &#20013;&#x6587; &lt;br&gt; & &eacute") == "a & b &nosuch; 中文 <br> & &eacute"
    assert one(X.strip_html, "<p>x</p>y<br/>z &amp;lt;<b>w</b>") == "x\ny\nz &lt;w" and one(X.strip_html, None) == ""
    assert one(lambda c: X.chinese_numbers(c), "十年，二十五岁，三年以上，两级，百年") == "10年，25岁，3年以上，2级，百年"
    assert [tuple(x) for x in one(X.quantities, "3-5年，至少2年，35岁以下，18周岁以上，工作1年经验")] == [("年", 3, 5, "between"), ("年", 2, None, "ge"), ("岁", 35, None, "le"), ("岁", 18, None, "ge"), ("年", 1, None, "ge")]
    assert one(X.protected, " 20-01 ") == "'20-01" and one(X.unprotected, "'20-01") == "20-01" and one(X.protected, None) == ""


def test_reports(spark):
    s = spark.createDataFrame([(0.9, True, "x"), (0.8, False, "y"), (0.7, None, "z"), (0.3, False, "y")], "s double, ok boolean, e string")
    got = {r["threshold"]: r for r in A.threshold_decision(s, "s", "ok", "e", [0.2, 0.85], 0.5).collect()}
    assert got[0.85]["recommended"] and not got[0.2]["passes"] and got[0.2]["errors"] == "y"
    assert A.batch_summary(s.limit(0), "s", "e").head()["n_rows"] == 0
    assert A.until_stable(lambda x: x + 1, 0, lambda x: min(x, 3), 10) == (3, 3, [0, 1, 2, 3, 3])
