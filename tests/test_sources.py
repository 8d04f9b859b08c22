"""File sources and sinks on inline files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lintel.operators import rollups
from lintel.sources import files
from lintel.sources.keywords import stopwords


def test_csv_quoting_round_trip(spark, tmpdir_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType()),
                           T.StructField("code", T.StringType())])
    rows = [(1, 'line one\nline two', "NA"), (2, 'a "quoted" word', None), (3, "back\\slash", "")]
    df = spark.createDataFrame(rows, schema)
    path = os.path.join(tmpdir_path, "rt")
    files.write_table(df, path, fmt="csv")
    back = {r.id: (r.t, r.code) for r in files.read_table(spark, path, schema).collect()}
    assert back[1] == ('line one\nline two', "NA")
    assert back[2][0] == 'a "quoted" word'
    assert back[3][0] == "back\\slash"
    assert back[2][1] is None and back[3][1] is None  # blank → NULL, "NA" stays text


def test_feature_properties_and_attribute_join(spark, tmpdir_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"iso_3": "KEN", "adm0_name1": "Kenya"}, "geometry": None},
        {"type": "Feature", "properties": {"iso_3": "ATA", "adm0_name1": "Antarctica"}, "geometry": None}]}
    path = os.path.join(tmpdir_path, "fc.json")
    with open(path, "w") as f:
        json.dump(fc, f)
    props = files.read_feature_properties(spark, path, ["iso_3", "adm0_name1"])
    vals = spark.createDataFrame([("KEN", 5.0), ("SYR", 2.0)], "iso_3 string, v double")
    out = {r.iso_3: (r.adm0_name1, r.v) for r in props.join(vals, "iso_3", "full").collect()}
    assert out == {"KEN": ("Kenya", 5.0), "ATA": ("Antarctica", None), "SYR": (None, 2.0)}


def test_report_bundle_manifest(spark, tmpdir_path):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    b = spark.createDataFrame([(1, "y")], "x int, y string")
    reports = {"keyword_year": a, "sector_year": b, "keyword_by_donor": b}
    base = os.path.join(tmpdir_path, "bundle")
    files.write_report_bundle(reports, base)
    written = {k: spark.read.parquet(f"{base}/{k}") for k in reports}
    man = {r.report: (r.columns, r.n_rows) for r in files.report_manifest(written, "keyword_").collect()}
    assert man == {"keyword_by_donor": ("x,y", 1), "keyword_year": ("x", 2)}


def test_stopwords_from_spark_lists():
    sw = stopwords()
    assert {"the", "und", "les", "los"} <= set(sw)
    assert len(sw) > 600


def test_frequency(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r.k: r.n for r in rollups.frequency(df, ["k"]).collect()} == {"a": 2, None: 1}


def test_all_string_reader(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "s2")
    with open(path + ".csv", "w") as f:
        f.write('a,b\n1,"x, ""y"""\n,NA\n')
    df = files.read_all_string(spark, path + ".csv", ["a", "b"])
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("1", 'x, "y"'), (None, "NA")]


def test_two_writers_publish_one_table(spark, tmpdir_path):
    """The second writer of a path keeps the first one's table and leaves nothing inside it."""
    from lintel.sources import warehouse
    path = os.path.join(tmpdir_path, "facts", "table")
    for n, rows in enumerate((3, 5)):
        tmp = f"{path}.tmp-{n}"
        spark.range(rows).withColumn("year", F.lit(n)).write.partitionBy("year").parquet(tmp)
        warehouse._publish(spark, tmp, path)
    assert spark.read.parquet(path).count() == 3
    assert sorted(x for x in os.listdir(path) if not x.startswith(".")) == ["_SUCCESS", "year=0"]
    assert not os.path.exists(f"{path}.tmp-1")
    with pytest.raises(RuntimeError):
        warehouse._publish(spark, os.path.join(tmpdir_path, "missing"), os.path.join(tmpdir_path, "other"))


def test_partitioned_tables_are_built_in_bounded_tasks(spark, tmpdir_path, monkeypatch):
    """Shuffle partitions follow the input, rows are not sorted by partition value, the session's settings come back."""
    from pyspark.sql import DataFrameWriter

    from lintel.sources import warehouse
    from lintel.sources.tables import Tables

    spark.range(1000).selectExpr("id AS c_custkey", "id % 7 AS y").write.parquet(f"{tmpdir_path}/customer.parquet")
    size, files = "spark.sql.shuffle.partitions", "spark.sql.maxConcurrentOutputFileWriters"
    was, seen, parquet = [spark.conf.get(k, None) for k in (size, files)], [], DataFrameWriter.parquet

    def spied(self, *args, **kwargs):
        seen.append([spark.conf.get(k) for k in (size, files)])
        return parquet(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    monkeypatch.setattr(warehouse, "PARTITION_BYTES", 100, raising=False)
    got = warehouse.materialized(Tables(spark, tmpdir_path), "bounded", lambda t: t.customer, partition_by=["y"])
    assert int(seen[0][0]) > int(was[0]) and seen[0][1] == "16"
    assert [spark.conf.get(k, None) for k in (size, files)] == was
    assert got.groupBy("y").count().count() == 7 and got.count() == 1000
