"""Queries in a process that was started in another folder and without a path to the library."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from chartloom import get_session
spark = get_session("anywhere", "local[8]", spark__sql__shuffle__partitions="2")
spark.sparkContext.setLogLevel("OFF")
failed = []
for name, query in entry.queries().items():
    if not name.startswith(("op", "pipeline")):
        continue
    try:
        query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
    except Exception as exc:
        failed.append(f"{name}: {str(exc)[-300:]}")
print("FAILED", failed)
"""


def test_queries_run_in_any_folder(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    assert "FAILED []" in done.stdout, done.stdout[-2000:] + done.stderr[-2000:]
