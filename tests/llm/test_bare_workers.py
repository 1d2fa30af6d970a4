"""All operators in a session whose workers cannot import the library."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from ledgernet.llm.queries import QUERIES
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
try:
    spark.range(1).mapInArrow(lambda batches: (__import__("ledgernet") and b for b in batches), "id long").collect()
    print("workers have the package")
except Exception:
    pass
for name in sorted(QUERIES):
    print(name, QUERIES[name](spark, {sf!r}).count(), flush=True)
"""


def test_workers_need_not_have_the_package(tmp_path):
    from ledgernet.llm.queries import QUERIES

    repo = Path(__file__).resolve().parent.parent.parent
    script = tmp_path / "bare.py"
    script.write_text(SCRIPT.format(repo=str(repo), sf="/root/testdata/sf0.001"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    told = [line.split()[0] for line in done.stdout.splitlines()]
    assert told == sorted(QUERIES), done.stdout + done.stderr[-3000:]
