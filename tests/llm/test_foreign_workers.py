"""Workers need not have the repository on their path: functions are sent to them by value."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from gapfill.session import build_session
spark = build_session("foreign", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}})
spark.sparkContext.setLogLevel("OFF")
queries = entry.queries()
for name in [n for n in queries if n.startswith("op")] + ["svd_embed", "near_dup_gate", "embedding_neighbours"]:
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_queries_run_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(repo=str(REPO))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]
