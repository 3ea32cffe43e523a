import pytest
from pyspark.sql import functions as F

from grainmill.sources import files
from grainmill.sources.shared import cut, drop_cut, put_bytes
from grainmill.sources.tables import first_existing, with_missing_columns
from grainmill.streaming import events as E


def test_csv_encodings(spark, tmp_path):
    for enc in ("utf-8-sig", "gbk"):
        p = tmp_path / f"{enc}.csv"
        p.write_bytes("编号,名称\n1,深圳公司\n2,\n".encode(enc))
        df = files.read_csv(spark, str(p), ["编号", "名称"])
        assert df.columns == ["编号", "名称"] and [r["名称"] for r in df.orderBy("编号").collect()] == ["深圳公司", None]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "gbk.csv"), ["没有"])


def test_json_and_terms(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"id": 1}, {"id": 2}, {"id": 3')
    assert sorted(r["id"] for r in files.read_json_array(spark, str(p), "struct<id:bigint>").collect()) == [1, 2]
    (tmp_path / "t.txt").write_text("# note\n项目 5 n\n\nexcel\n")
    assert {tuple(r) for r in files.read_terms(spark, str(tmp_path / "t.txt")).collect()} == {("项目", 5, "n"), ("excel", None, None)}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").filter("a IS NOT NULL").count() == 2
    (tmp_path / "current.txt").write_text("v8.json\n")
    assert files.pointed(spark, str(tmp_path)).endswith("/v8.json")


def test_names_and_columns(spark):
    assert files.normal_names(["A b", "a-b", "", "1x", "名称"]) == ["a_b", "a_b_2", "column", "c_1x", "名称"]
    d = spark.createDataFrame([(1,)], "a int")
    assert with_missing_columns(d, {"a": "bigint", "b": "string"}).head().asDict() == {"a": 1, "b": None}
    assert first_existing(d, ["x", "a"]) == "a"


def test_writes(spark, tmp_path):
    d = spark.createDataFrame([("v1", 1), ("v2", 2)], "version string, x int")
    files.write_partitioned(d, str(tmp_path / "p"), "version")
    files.write_partitioned(spark.createDataFrame([("v2", 3)], "version string, x int"), str(tmp_path / "p"), "version")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("version", "x").collect()} == {("v1", 1), ("v2", 3)}
    files.write_shards(spark.range(7).coalesce(1), str(tmp_path / "s"), 3)
    assert len(list((tmp_path / "s").glob("*.json"))) == 3
    assert '"rows": 2' in files.manifest(d, "d", ["version"]) and files.markdown(d).count("\n") == 3
    assert files.append_latest(d.withColumn("at", F.lit(1)), d.limit(1).withColumn("at", F.lit(2)), ["version"], "at").count() == 2
    assert files.pending(d, d.limit(1), ["version"]).count() == 1


def test_cut_and_ship(spark):
    from pyspark import SparkFiles

    c = cut(spark.range(10))
    assert c.count() == 10
    drop_cut(c)
    name = put_bytes(spark, b"abc" * 5)
    assert open(SparkFiles.get(name), "rb").read() == b"abc" * 5


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:10:00", i % 3) for i in range(40)]
    src = spark.createDataFrame(rows, "id int, t string, k int").select("id", F.to_timestamp("t").alias("ts"), "k")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    st = E.tumbling(E.read_stream(spark, str(tmp_path / "in"), src.schema, 1), "ts", ["k"])
    q = st.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("tumbled").collect()} == {tuple(r) for r in E.tumbling(src, "ts", ["k"]).collect()}
    state = {}
    merge = E.merge_batches(lambda: state.get("t"), lambda df: state.update(t=cut(df)), ["id"], "ts")
    merge(src, 0)
    merge(src, 0)  # replayed
    assert state["t"].count() == 40
    assert E.sessions(src.filter("k = 0"), "ts", "k").agg(F.sum("n")).head()[0] == src.filter("k = 0").count()
