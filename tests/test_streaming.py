"""Incremental scoring stream: each distinct text is scored exactly once."""

import os

from pyspark.sql import types as T

from lintel.streaming.incremental import start_scoring_stream

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


def test_stream_scores_each_text_once(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bbb")], SCHEMA).write.parquet(os.path.join(src, "b1"))
    q, scores = start_scoring_stream(spark, src + "/*", SCHEMA, "t", name="t1-" + os.path.basename(tmpdir_path),
                                     available_now=True)
    q.awaitTermination(120)
    first = spark.read.parquet(scores)
    assert first.count() == 2
    spark.createDataFrame([(4, "aa"), (5, "cccc"), (6, None)], SCHEMA).write.parquet(os.path.join(src, "b2"))
    q2, _ = start_scoring_stream(spark, src + "/*", SCHEMA, "t", name="t1-" + os.path.basename(tmpdir_path),
                                 available_now=True)
    q2.awaitTermination(120)
    out = spark.read.parquet(scores)
    assert out.count() == 3
    assert out.select("text_key").distinct().count() == 3
