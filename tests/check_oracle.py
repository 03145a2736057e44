"""Run registered queries against their SQL: python tests/check_oracle.py [sf] [module-or-name ...]"""

from __future__ import annotations

import importlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.oracle import compare, connect
from tidemark.catalog.base import REGISTRY
from tidemark.session import build_session


def main() -> None:
    sf, wanted = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    picked: list[str] = []
    for w in wanted:
        try:
            importlib.import_module(f"tidemark.catalog.{w}")
            picked += [n for n, q in REGISTRY.items() if q.run.__module__.endswith(f".{w}")]
        except ModuleNotFoundError:
            importlib.import_module("tidemark.catalog")
            picked.append(w)
    if not wanted:
        importlib.import_module("tidemark.catalog")
        picked = list(REGISTRY)
    spark = build_session(
        master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in picked:
        q = REGISTRY[name]
        t = time.time()
        try:
            problems = compare(spark, con, q.run, q.sql, sf_dir) if q.sql else (
                [] if q.run(spark, sf_dir).collect() else ["empty result"])
        except Exception as e:  # report and go on
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t:.2f}s{'' if q.sql else ' (no sql)'}", *problems, sep="\n     ", flush=True)
    print(f"{len(picked)} queries, {failed} failed")


if __name__ == "__main__":
    main()
