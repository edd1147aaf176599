"""Run every query and its SQL side by side: python tests/check_all.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from compare import connect, differences  # noqa: E402
from creativeaudit import session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
only = sys.argv[2:]
path = f"/root/testdata/sf{sf}"
spark = session.build("local[8]", "check", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("OFF")
con = connect(path)
oracle = E.oracle_sql()
bad = 0
for name, fn in E.queries().items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        if name in oracle:
            d = differences(fn(spark, path), con, oracle[name])
        else:
            d = None if fn(spark, path).count() >= 0 else "no rows"
    except Exception as exc:
        d = f"{type(exc).__name__}: {(str(exc)[:300] + ' ... ' + str(exc)[-500:] if len(str(exc)) > 800 else str(exc))}"
    bad += d is not None
    print(f"{'ok  ' if d is None else 'FAIL'} {time.time() - t:6.2f}s {name} {'' if name in oracle else '(rows only)'} {d or ''}", flush=True)
print("failures", bad)
