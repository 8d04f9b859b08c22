"""Session construction and the shared scratch location.

Library code never decides where a cluster keeps its files: intermediate
tables go under the folder the session names in ``spark.checkpoint.dir``.
Only when that is unset (local tests) do we pick a private temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "lintel",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every plan here assumes.

    AQE stays on so the runtime can coalesce small shuffles, split skewed
    partitions and turn a sort-merge join into a broadcast once it has seen
    the real size of a side.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="lintel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "lintel", f"{name}-{uuid.uuid4().hex}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lintel`` importable in the executors' Python workers.

    The pandas scorer/encoder functions run in executor Python processes,
    which import this package; it is zipped next to the package (named by a
    hash of its sources) and added with ``addPyFile`` once per application,
    the same way ``--py-files`` ships code to a cluster."""
    import hashlib
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    sources = []
    for dirpath, _dirs, names in os.walk(pkg_dir):
        for n in sorted(names):
            if n.endswith(".py"):
                sources.append(os.path.join(dirpath, n))
    sources.sort()
    digest = hashlib.sha1()
    for p in sources:
        with open(p, "rb") as f:
            digest.update(p[len(root):].encode() + f.read())
    build = tempfile.mkdtemp(prefix="lintel-pyfiles-")  # the driver's own; addPyFile sends it on
    target = os.path.join(build, f"lintel-{digest.hexdigest()[:12]}.zip")
    if not os.path.exists(target):
        part = f"{target}.{uuid.uuid4().hex}.part"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sources:
                z.write(p, os.path.relpath(p, root))
        os.replace(part, target)
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def written(df, name: str):
    """``df`` written once under the shared folder and read back, so that nothing before it is computed again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
