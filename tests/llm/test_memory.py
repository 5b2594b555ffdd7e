"""What executors keep between the pipeline's stages: in a session of its own, whose executors are processes."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

PROGRAM = """
import os, sys
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

tmp = sys.argv[1]
conf = {"spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{tmp}/shared"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def resident(batches):
    list(batches)
    parent = lambda pid: int(open(f"/proc/{pid}/stat").read().rpartition(")")[2].split()[1])
    pid = parent(os.getppid())  # worker, daemon, JVM
    mb = next(int(x.split()[1]) for x in open(f"/proc/{pid}/status") if x.startswith("VmRSS")) >> 10
    yield pa.RecordBatch.from_arrays([pa.array([mb])], names=["mb"])

taken = lambda: max(r["mb"] for r in spark.range(0, 8, 1, 8).mapInArrow(resident, "mb long").collect())
spark.range(0, 8, 1, 8).select(F.sum(F.size(F.sequence(F.lit(0).cast("long"), F.col("id") + 45_000_000)))).collect()  # 360 MB in each executor
full = taken()
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
corpus_pipeline.exact_dedup(spark, docs, "/root/testdata/sf0.001").collect()
print("MB", full, taken())
os._exit(0)
"""


def test_a_stage_begins_with_the_heap_given_back(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    gone = ("SPARK_ENV_LOADED", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")
    env = {k: v for k, v in os.environ.items() if k not in gone} | {"SPARK_HOME": str(home), "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_SCALA_VERSION": "2.13"}
    run = subprocess.run([sys.executable, "-c", PROGRAM, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    found = [x for x in run.stdout.splitlines() if x.startswith("MB ")]
    assert found, run.stderr[-2000:]
    before, after = map(int, found[0].split()[1:])
    assert before > 500 and after < before - 150, (before, after)
