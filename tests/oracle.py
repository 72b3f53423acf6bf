"""Compare a registered query with its SQL on DuckDB. Run as a script for a report with times."""

from __future__ import annotations

import glob
import math
import numbers
import os
import sys
import time

import duckdb
import pandas as pd

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat()
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    # An integer on one side must not be a float on the other.
    if isinstance(value, numbers.Integral):
        return int(value)
    if isinstance(value, numbers.Real):
        return float(value)
    return str(value)


# Spark types and the DuckDB types that hold the same values.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and the SQL's: types, columns, row count or values."""
    spark_types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}
    sql_types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    if spark_types != sql_types:
        return f"types {spark_types} != {sql_types}"
    # Integers stay integers beside nulls.
    whole = {name: "Int64" for name, kind in spark_types.items() if kind in ("BIGINT", "INTEGER")}
    return difference(df.toPandas().astype(whole), con.execute(sql).fetchdf().astype(whole))


def canonical(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    rows = [tuple(_cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return columns, sorted(rows, key=repr)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    (left_cols, left), (right_cols, right) = canonical(spark_frame), canonical(sql_frame)
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"{len(left)} rows, SQL has {len(right)}"
    for a, b in zip(left, right):
        if repr(a) != repr(b):
            return f"{a} != {b}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from emberlog.session import local_session

    sf_dir = os.environ.get("SF_DIR", f"{TESTDATA}/sf0.01")
    spark, con = local_session(), connect(sf_dir)
    wanted, failed = sys.argv[1:], 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            t0 = time.time()
            df = fn(spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                verdict = f"rows only: {df.count()}"
            else:
                problem = compare(df, con, sql)
                verdict = "ok" if problem is None else f"DIFFERS: {problem}"
        except Exception as error:
            verdict = f"ERROR: {str(error)[:1500]}"
        failed += verdict.startswith(("DIFFERS", "ERROR"))
        print(f"{name:32s} {time.time() - t0:6.2f}s  {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
