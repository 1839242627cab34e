"""Prints how each named query compares: python tests/check.py [folder] [name or prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from flowlark.session import local_session  # noqa: E402
from tests.compare import checker, differences  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = checker(folder)
    sqls = entry.oracle_sql()
    good = bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                found = differences(df, con, sqls[name])
            else:
                found = [] if df.count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:900]}"]
        took = time.time() - began
        print(f"{'ok  ' if not found else 'BAD '} {name:32s} {took:6.2f}s {'' if name in sqls else 'rows only'}", flush=True)
        for line in found:
            print("     ", line)
        good, bad = good + (not found), bad + bool(found)
    print(f"{good} good, {bad} bad")
