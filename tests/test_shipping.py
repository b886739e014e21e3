"""Functions reach Python workers that do not have the package."""

import os
import subprocess
import sys

PROGRAM = """
import os, sys
sys.path.insert(0, sys.argv[1])
from haulage.session import get_session
from haulage.sinks import export, manifest
from haulage.operators import verify
from pyspark.sql import functions as F
spark = get_session("away", master="local[2]", spark__ui__enabled="false")
export.export_single(spark.range(10), sys.argv[2], "t", 10)
files = manifest.list_data_files(spark, sys.argv[2])
assert verify.verify_readable(files).first()["readable"]
assert verify.file_checksums(files.withColumn("table_name", F.lit("t"))).count() == 1
"""


def test_workers_need_no_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run").mkdir()
    subprocess.run(
        [sys.executable, "-c", PROGRAM, root, str(tmp_path / "out")],
        cwd=tmp_path / "run", env=env, check=True, capture_output=True, timeout=300,
    )
