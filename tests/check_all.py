"""Prints time and outcome of every registered query: check_all.py [sf_dir] [name ...]"""

import sys
import tempfile
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from sievework.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
wanted = sys.argv[2:]
spark = build_session(
    "check",
    master="local[8]",
    **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="sievework-check-"),
    },
)
spark.sparkContext.setLogLevel("ERROR")
con, sql = connect(sf), oracle_sql()
good = bad = 0
for name, fn in queries().items():
    if wanted and name not in wanted:
        continue
    start = time.time()
    try:
        problem, rows = compare(spark, con, sf, fn, sql.get(name))
    except Exception as error:
        problem, rows = f"{type(error).__name__}: {str(error)[:400]}", -1
        if len(wanted) == 1:
            traceback.print_exc()
    took = time.time() - start
    good, bad = good + (problem is None), bad + (problem is not None)
    print(f"{'ok ' if problem is None else 'BAD'} {took:6.2f}s {rows:8d} {name}{'' if name in sql else ' (rows only)'} {problem or ''}", flush=True)
print(f"{good} ok, {bad} bad")
