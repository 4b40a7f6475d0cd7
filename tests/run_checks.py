"""python tests/run_checks.py SF_DIR [name-prefix ...]: compare registered queries with their twins."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points
from emberlog.durable import sweep
from emberlog.session import build_session
from tests.oracle import compare, open_duckdb


def main():
    sf, wanted = sys.argv[1], sys.argv[2:]
    extra = {} if "PLAIN" in os.environ else {"shuffle_partitions": 8}
    spark = build_session(master="local[8]", spark__driver__memory="16g", spark__ui__enabled="false", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(sf)
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                fault = compare(df, con, oracles[name])
                kind = "same"
            else:
                fault, kind = None, f"{df.count()} rows"
        except Exception as e:  # report and go on
            fault = f"{type(e).__name__}: {str(e)[:700]}"
        bad += fault is not None
        print(f"{time.time() - start:6.1f}s {name}: {kind if fault is None else 'WRONG ' + fault}", flush=True)
    print("wrong:", bad)
    sweep(spark)


main()
