from pyspark.sql import functions as F

from quillspark.operators.versioned import field_equals
from quillspark.plans import explain
from quillspark.sources import records, tables


def test_record_log(spark, tmp_path):
    spark.dataSource.register(records.RecordLog)
    rows = [(i, b"x" * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "lsn long, payload binary")
    df.write.format("recordlog").mode("append").save(str(tmp_path / "log"))
    back = spark.read.format("recordlog").load(str(tmp_path / "log"))
    assert sorted((r.lsn, bytes(r.payload)) for r in back.collect()) == rows
    assert spark.read.format("recordlog").option("since", "150").load(str(tmp_path / "log")).count() == 50


def test_damaged_records():
    data = records.encode(1, b"a") + records.encode(2, b"bb") + records.encode(3, b"c")
    broken = bytearray(data)
    broken[len(records.encode(1, b"a")) + records.HEAD.size] ^= 1
    assert [x for x, _ in records.decode(bytes(broken))] == [1, 3]
    assert [x for x, _ in records.decode(data[:-1])] == [1, 2]


def test_bson(spark):
    d = {"name": "Alice", "age": 28, "ok": True, "x": 1.5, "none": None}
    assert records.bson_fields(records.bson_document(d)) == d
    df = spark.createDataFrame([(1, records.bson_document(d)), (2, None)], "id int, b binary").withColumn("doc", records.bson_json()("b"))
    assert field_equals(df, "doc", "name", "Alice").count() == 1


def test_sorted_run_prunes(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    tables.write_sorted(df, str(tmp_path / "run"), "id", 4)
    back = tables.read(spark, str(tmp_path / "run")).where("id = 77").select("v")
    assert back.first().v == 154 and "EqualTo(id,77)" in explain.pushed_filters(back)[0]
    assert explain.read_columns(back)[0] == "struct<id:bigint,v:bigint>"


def test_formats(spark, tmp_path, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    for form in ("orc", "json", "csv"):
        tables.write(df, str(tmp_path / form), form)
        assert tables.read(spark, str(tmp_path / form), form, df.schema.simpleString()[7:-1].replace(":", " ")).count() == 25
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert tables.page_links(pages).count() > 0


def test_plans(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert explain.exchanges(li.groupBy("l_returnflag").count()) == 1
