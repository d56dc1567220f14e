"""Executors have no copy of the package: only the driver's own path leads to it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
JOB = """
import sys
sys.path.insert(0, {root!r})
from wavelens.session import get_session
import __spark_entry__ as entry
spark = get_session("local[2]", shuffle_partitions=2)
for name in {names!r}:
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    print(name, len(df.collect()))
"""


def test_queries_from_another_folder(tmp_path):
    names = ["op1_language", "op8_toxicity", "op11_conversation_repair", "op12_merkle_manifest", "op13_token_counts"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB.format(root=ROOT, names=names)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
