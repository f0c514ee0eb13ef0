"""A session without a checkpoint folder still checkpoints (private folder set on the context)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r"""
import sys
sys.path.insert(0, %r)
from pyspark import SparkConf
from pyspark.sql import SparkSession
conf = SparkConf().setMaster("local[2]").set("spark.ui.enabled", "false")
conf.remove("spark.checkpoint.dir") if conf.contains("spark.checkpoint.dir") else None
spark = SparkSession.builder.config(conf=conf).getOrCreate()
spark.sparkContext._jsc.sc().conf().remove("spark.checkpoint.dir")
from tagframe.session import ensure_checkpoint_dir
from tagframe.operators.models import materialize
d = ensure_checkpoint_dir(spark)
print("DIR", d)
print("ROWS", materialize(spark.range(10)).count())
"""


def test_checkpoint_without_configured_folder(tmp_path):
    # an empty conf folder: no spark-defaults, so no checkpoint folder is configured
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", SCRIPT % ROOT], capture_output=True, text=True, env=env, timeout=300)
    assert "ROWS 10" in out.stdout, out.stdout + out.stderr[-2000:]
    assert "tagframe-ckpt-" in out.stdout
