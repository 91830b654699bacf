"""Tables written on the way: where they lie, and that they go."""

import os
import subprocess
import sys

import pytest

from tallyloom.functions import spill

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_RUN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from tallyloom.functions.spill import shared_dir, written
print(shared_dir(spark), written(spark.range(5), "t").count())
"""


def test_a_run_leaves_nothing(tmp_path):
    out = subprocess.run([sys.executable, "-c", _RUN, str(tmp_path / "shared")], capture_output=True, text=True, cwd=_ROOT, timeout=120, check=True).stdout
    assert out.split() == [(tmp_path / "shared").as_uri(), "5"]
    left = [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet")]
    assert left == []


def test_forget(spark):
    df = spill.written(spark.range(3), "t")
    assert df.count() == 3
    path = df.inputFiles()[0]
    spill.forget(spark)
    assert not os.path.exists(path.removeprefix("file://"))


class _Elsewhere:
    """A session on a cluster without a shared folder."""

    def __init__(self, master):
        empty = type("Conf", (), {"get": staticmethod(lambda *_: None)})()
        held = type("Option", (), {"isDefined": staticmethod(lambda: False)})()
        scala = type("Scala", (), {"getCheckpointDir": staticmethod(lambda: held)})()
        context = type("Context", (), {"master": master, "getConf": staticmethod(lambda: empty), "_jsc": type("J", (), {"sc": staticmethod(lambda: scala)})()})()
        self.conf, self.sparkContext = empty, context


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="share"):
        spill.shared_dir(_Elsewhere(master))
