"""Workers need no copy of this package: what is sent to them is plain values and functions by value."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from faultloom.session import local_session
spark = local_session(2, "bare")

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("faultloom") is not None]})

assert not any(r["found"] for r in spark.range(4).mapInArrow(importable, "found boolean").collect())
import __spark_entry__ as entry
queries = entry.queries()
for name in sys.argv[3:]:
    assert queries[name](spark, sys.argv[2]).count() > 0, name
print("fine")
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ["op1_quality", "op2_lm_scoring", "op3_token_files", "op4_token_counts", "op6_ann", "op7_ngram_join", "op8_decontamination",
             "op9_mixing", "op11_hard_negatives", "op12_vector_codes", "op13_near_dedup"]
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(ROOT), "/root/testdata/sf0.001", *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900
    )
    assert "fine" in run.stdout, run.stderr[-3000:]
