"""Run queries against their oracles from the command line: ``python tests/check.py [sf] [names…]``."""

from __future__ import annotations

import os
import sys
import time
import traceback
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from labelmill.session import local_session  # noqa: E402


def main() -> None:
    sf, *names = sys.argv[1:] or ["0.01"]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), oracle.connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []

    def run(name: str) -> None:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                problem = oracle.compare(df, con.cursor(), sql[name])
                note = "ok" if problem is None else f"MISMATCH {problem}"
            else:
                note = f"rows {len(df.collect())}"
        except Exception as error:
            note = "ERROR " + str(error).split("JVM stacktrace")[0][:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if note.startswith(("MISMATCH", "ERROR")):
            bad.append(name)
        print(f"{name:28s} {time.time() - start:6.2f}s {note}", flush=True)

    with ThreadPoolExecutor(int(os.environ.get("THREADS", "6"))) as pool:
        list(pool.map(run, names or queries))
    print("failed:", bad)


if __name__ == "__main__":
    main()
