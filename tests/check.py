"""Run registered queries against their SQL: `python tests/check.py <sf> [name or prefix...]`."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.support import DATA, differences, duck, session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> None:
    sf, *wanted = sys.argv[1:]
    path = f"{DATA}/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(path)
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            frame = run(spark, path)
            if name in sqls:
                report = differences(frame, con, sqls[name])
                count = ""
            else:
                report, count = None, f"{len(frame.collect())} rows only"
        except Exception as problem:  # noqa: BLE001
            report, count = f"{type(problem).__name__}: {str(problem)[:600]}", ""
            if len(wanted):
                traceback.print_exc(limit=3)
        bad += report is not None
        print(f"{'FAIL' if report else 'ok':4} {name:32} {time.time() - began:6.2f}s {count} {report or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
