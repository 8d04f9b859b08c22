"""The entry module needs no jar, file or JVM to be imported."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import glob, zipfile
def fail(*a, **k):
    raise FileNotFoundError("no jar may be looked up")
glob.glob = zipfile.ZipFile = fail
import __spark_entry__ as e
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
q, o = e.queries(), e.oracle_sql()
assert len(q) >= 57 and set(o) <= set(q) and all(o.values())
"""


def test_import_without_jar_or_jvm():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)
