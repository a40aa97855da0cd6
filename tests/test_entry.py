"""The entry module works without a session, from another folder, with pyspark in its zip."""

import glob
import os
import subprocess
import sys

import pyspark

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIB = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")


def test_entry_imports_like_spark_submit(tmp_path):
    path = [*glob.glob(f"{LIB}/pyspark.zip"), *glob.glob(f"{LIB}/py4j-*.zip")]
    code = (f"import sys; sys.path[:0] = {path!r}; import pyspark; assert 'pyspark.zip' in pyspark.__file__ or not {path!r}\n"
            f"sys.path.insert(0, {REPO!r}); import __spark_entry__ as e\n"
            "q, sql = e.queries(), e.oracle_sql(); assert len(q) >= 59 and len(sql) >= 54 and set(sql) <= set(q)\n"
            "from pyspark import SparkContext; assert SparkContext._active_spark_context is None")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
