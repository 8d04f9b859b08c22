"""Incremental distinct-text scoring with Structured Streaming (T8 + S8).

The reference scores each distinct text once and keeps a cache of computed
vectors so that a rerun does not recompute them.  As a stream: new files of
text rows arrive in a folder; every micro-batch keys its texts by hash,
drops keys already in the score table (left anti join), scores only the new
distinct texts with the pluggable pandas scorer, and appends them.  The
stream's checkpoint and the score table live under the shared checkpoint
folder, so a restarted query (or a lost executor) resumes without scoring a
text twice: the score table is the state, and the append happens before
the batch is committed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lintel.operators.text import SCORE_SCHEMA, Scorer, length_scorer, text_key
from lintel.session import ensure_checkpoint_dir


def _scored_keys(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select("text_key")
    except AnalysisException:
        return None


def score_new_texts(batch: DataFrame, text: str, scores_path: str, scorer: Scorer = length_scorer) -> int:
    """One micro-batch: score the distinct texts not yet in ``scores_path``
    and append them; returns nothing large (the append is done by Spark)."""
    spark = batch.sparkSession
    keyed = (batch.select(text_key(text).alias("text_key"), F.col(text).alias("_t"))
             .filter(F.col("_t").isNotNull()).dropDuplicates(["text_key"]))
    done = _scored_keys(spark, scores_path)
    if done is not None:
        keyed = keyed.join(done, "text_key", "left_anti")

    def run(batches):
        for b in batches:
            out = scorer(b["_t"])
            out.insert(0, "text_key", b["text_key"].values)
            yield out

    keyed.mapInPandas(run, SCORE_SCHEMA).write.mode("append").parquet(scores_path)
    return 0


def start_scoring_stream(spark: SparkSession, source_dir: str, schema: T.StructType, text: str,
                         name: str = "text_scores", scorer: Scorer = length_scorer,
                         available_now: bool = False):
    """Start the stream over the parquet files arriving in ``source_dir``.

    Returns ``(query, scores_path)``; read the scores with
    ``spark.read.parquet(scores_path)`` and join them back on ``text_key``."""
    base = os.path.join(ensure_checkpoint_dir(spark), "lintel", "streams", name)
    scores_path = os.path.join(base, "scores")
    stream = spark.readStream.schema(schema).parquet(source_dir)
    writer = (stream.writeStream
              .option("checkpointLocation", os.path.join(base, "checkpoint"))
              .foreachBatch(lambda df, _epoch: score_new_texts(df, text, scores_path, scorer)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(), scores_path
