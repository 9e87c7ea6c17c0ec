"""Executors without the package: a session started in another folder, whose workers cannot import it."""

import os
import subprocess
import sys
from pathlib import Path

from tests.llm.helpers import frame, prose

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # the driver has it, its workers do not
from pageloom.session import build_session
from pageloom.llm.queries import LLM_QUERIES
from pageloom.plans import QUERIES
spark = build_session("workers", "local[2]", 2)
def seen(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("pageloom") is None])], names=["x"])
assert all(r.x for r in spark.range(2).mapInArrow(seen, "x boolean").collect())
for name in {names!r}:
    assert LLM_QUERIES[name](spark, {folder!r}).count() > 0
print("done")
"""


def test_queries_run_where_workers_lack_the_package(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(i, prose(rng, 40) + f" password = {'%012x' % rng.getrandbits(48)}", "en" if i % 2 else "de") for i in range(40)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i + j) for j in range(16)], 1) for i in range(9)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    repo = str(Path(__file__).resolve().parents[2])
    names = ["op1_language_id", "op9_secret_scan", "op11_periodic_runs", "op12_balanced_shards", "op13_vector_codes"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=str(tmp_path), names=names)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-3000:]
