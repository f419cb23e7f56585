"""Run registered queries against their SQL and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

import sys
import time

import duckdb
import pandas as pd

from checks.oracles import statements
from checks.queries import registered
from procsight.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sorted_rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = sorted_rows(ours), sorted_rows(theirs)
    for column in a.columns:
        same = (a[column] == b[column]) | (a[column].isna() & b[column].isna())
        if not same.all():
            at = same.idxmin()
            return (
                f"{(~same).sum()} values differ in {column}, first {a[column][at]!r} vs {b[column][at]!r}\n"
                f"    {a.loc[at].to_dict()}\n    {b.loc[at].to_dict()}"
            )
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    queries, oracles = registered(), statements()
    assert set(oracles) <= set(queries), set(oracles) - set(queries)
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            ours = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            problem = difference(ours, con.execute(oracles[name]).df()) if name in oracles else None
            if name not in oracles and ours.empty:
                problem = "no rows"
        except Exception as error:
            took, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in oracles else "rows"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {took:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
