"""Python workers get the package from the driver, wherever they run."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from tallyforge.session import build_session
from tallyforge.operators.catalog import extract_catalog
from tallyforge.operators.selection import knn_topk
spark = build_session("shipping", "local[2]", 2, spark__ui__enabled="false")
points = spark.createDataFrame([(i, [3700.0 + i * 1e-6, 1.0]) for i in range(6)], "id long, vector array<double>")
near = knn_topk(points, points, 1, exclude_self=True).orderBy("query_id").collect()
assert [(r.neighbor_id, r.distance) for r in near] == [(1, 1e-6), (0, 1e-6), (1, 1e-6), (2, 1e-6), (3, 1e-6), (4, 1e-6)], near
files = spark.createDataFrame([("a", "module m {{\\n extern func f {{\\n }}\\n}}")], "path string, text string")
extract_catalog(files).collect()
print("done")
"""


def test_workers_import_the_package_without_a_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0 and "done" in done.stdout, done.stderr[-2000:]
