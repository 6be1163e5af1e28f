"""Runs registered queries against their SQL: python tests/check_queries.py FOLDER [name ...]"""

from __future__ import annotations

import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from prospecta.session import build_session
from prospecta.workload import all_queries, all_sql
from tests.oracle import connect, differences


def main() -> None:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", "check", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    queries, sql = all_queries(), all_sql()
    for name in [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]:
        start = time.time()
        try:
            result = queries[name](spark, folder)
            problem = differences(result, connection, sql[name]) if name in sql else f"rows only: {result.count()}"
        except Exception:
            problem = traceback.format_exc()[-1500:]
        state = "ok" if problem is None else "--" if problem.startswith("rows only") else "BAD"
        failed += state == "BAD"
        print(f"{state:4}{name:32}{time.time() - start:7.2f}s {'' if problem is None else problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
