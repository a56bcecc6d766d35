"""Run every registered query against its DuckDB oracle: python tests/run_oracle.py [sf_dir] [name...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fluxsieve.session import local_session  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402
import __spark_entry__ as E  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = set(sys.argv[2:])
    spark = local_session(8, shuffle_partitions=8)
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                ok, msg = True, f"rows-only: {df.count()} rows"
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len(qs) - bad if not only else len(only) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main()
