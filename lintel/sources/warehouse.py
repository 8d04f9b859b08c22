"""Warehouse tables (S3) built from the stand-in views.

The reference extracts its two facts from warehouse tables with a projection
and predicates.  Here the stand-in facts are multi-way joins of the driver
tables; recomputing those joins for every report would be the wrong plan at
scale.  Each fact is therefore written once per (input folder, definition)
as a parquet table under the session's shared checkpoint folder, partitioned
by year, and every report reads it with column pruning, pushed filters and
partition pruning — exactly how a report reads a warehouse table.

The table path is keyed by the input folder and a hash of the package source
(the training-data operators aside), so a changed definition never reads a
stale table within an application.  A table is written to
a private temporary path and published with one directory rename, and is
only read once its ``_SUCCESS`` marker exists, so a failed or lost writer
(or two concurrent ones) never leaves a half table to read.

While a table is built, the joins are dealt over as many partitions as the
input fills with ``PARTITION_BYTES`` each, and a task keeps one open file per
partition value instead of sorting its rows, so a task's memory does not grow
with the input; tasks that meet more than ``OPEN_FILES`` values sort the rest.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.operators.joins import estimated_bytes
from lintel.session import ensure_checkpoint_dir
from lintel.sources.tables import Tables


PARTITION_BYTES = 16 << 20     # of the input's files, for each shuffle partition of a build
OPEN_FILES = 16                # of a task that writes a partitioned table
ROW_GROUP_BYTES = 16 << 20     # of each of them, as buffered


def _fs_path(spark, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def _exists(spark, path: str) -> bool:
    fs, p = _fs_path(spark, path + "/_SUCCESS")
    return fs.exists(p)


def _publish(spark, tmp: str, path: str) -> None:
    """Move a finished table into place with one directory rename that fails
    if the place is taken; then another writer's (identical) table is kept and
    this one removed."""
    fs, src = _fs_path(spark, tmp)
    _, dst = _fs_path(spark, path)
    src, dst = fs.makeQualified(src), fs.makeQualified(dst)
    fs.mkdirs(dst.getParent())
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(src.toUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(src, dst, sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if not _exists(spark, path):
            raise RuntimeError(f"could not publish {path}") from e
        fs.delete(src, True)


@lru_cache(maxsize=1)
def _package_digest() -> str:
    """Hash of every source file of the package but the training-data operators,
    on which no table depends: any other change gives the tables new paths."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for dirpath, _dirs, names in sorted(os.walk(root)):
        if os.path.relpath(dirpath, root).split(os.sep)[0] == "llm":
            continue
        for n in sorted(names):
            if n.endswith(".py"):
                with open(os.path.join(dirpath, n), "rb") as f:
                    h.update(n.encode() + f.read())
    return h.hexdigest()


def table_path(t: Tables, name: str) -> str:
    key = hashlib.sha1(f"{os.path.abspath(t.sf_dir)}|{_package_digest()}".encode()).hexdigest()[:16]
    return os.path.join(ensure_checkpoint_dir(t.spark), "lintel", "warehouse", f"{name}-{key}")


def build_partitions(t: Tables) -> int:
    """Shuffle partitions of a build: the session's, or more if the tables read so far are large."""
    read = [*t._cache.values(), *t.__dict__.get("_warehouse", {}).values()]
    need = -(-sum(estimated_bytes(df) or 0 for df in read) // PARTITION_BYTES)
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), need)


@contextmanager
def _settings(spark, **conf):
    """The session's settings changed for a while (``_`` stands for a dot)."""
    conf = {k.replace("_", "."): str(v) for k, v in conf.items()}
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialized(t: Tables, name: str, build: Callable[[Tables], DataFrame],
                 partition_by: Sequence[str] = (), partition_type: str = "bigint") -> DataFrame:
    """Read the warehouse table ``name``; write it first if it is missing."""
    cache = t.__dict__.setdefault("_warehouse", {})
    if name in cache:
        return cache[name]
    path = table_path(t, name)
    if not _exists(t.spark, path):
        tmp = f"{path}.tmp-{uuid.uuid4().hex}"
        df = build(t)
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by).option("parquet.block.size", ROW_GROUP_BYTES)
        with _settings(t.spark, spark_sql_shuffle_partitions=build_partitions(t),
                       spark_sql_maxConcurrentOutputFileWriters=OPEN_FILES):
            w.parquet(tmp)
        _publish(t.spark, tmp, path)
    df = t.spark.read.parquet(path)
    # Partition discovery infers the narrowest type for the directory values;
    # restore the declared type of the partition columns (years are BIGINT).
    for c in partition_by:
        df = df.withColumn(c, F.col(c).cast(partition_type))
    cache[name] = df
    return df
