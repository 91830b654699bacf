"""What Python workers keep of an executor's memory between tasks."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import workers
from tallyloom.llm import near_dedup, pieces, toxicity

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_RUN = """
import re
import pyarrow as pa
from tallyloom.functions.workers import tidy

def resident():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

pins = []
def run(batches):
    for b in batches:
        held = [bytes(600) for _ in range(200_000)]
        pins.append(bytes(600))  # the end of the heap stays in use
        yield b

began = resident()
for made in (run, tidy(run)):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    print([b.num_rows for b in made(iter([batch, batch]))], resident() - began)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_tidy_worker_gives_back_what_it_freed():
    out = subprocess.run([sys.executable, "-c", _RUN], capture_output=True, text=True, cwd=_ROOT, timeout=60, check=True).stdout
    (rows, plain), (same, left) = (re.match(r"(\[.*\]) (-?\d+)", line).groups() for line in out.splitlines())
    assert rows == same == "[2, 2]"
    assert int(plain) > 100 and int(left) < 40


def test_stages_of_the_pipeline_run_tidy(spark, monkeypatch):
    words = [" ".join(f"w{i % 7}{j}" for j in range(40)) for i in range(24)]
    rows = [(i, w + (f" end{i}" if i % 2 else ""), "en", "s") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    given = []
    plain = type(docs).mapInArrow

    def noted(self, func, *args, **kwargs):
        given.append(func)
        return plain(self, func, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    toxicity.drop_toxic(docs, labels, F.lit(True))
    near_dedup.drop_near_duplicates(docs)
    pieces.encoded(docs, ["doc_id"], 2)
    assert len(given) >= 5  # toxicity, sketches, sets, links, pieces
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append(1))
    for n, func in enumerate(given, 1):
        list(func(iter([])))
        assert len(calls) == n, func
