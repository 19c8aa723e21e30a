"""Run registered queries next to their SQL in DuckDB: ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8, partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def duck(sf_dir: str):
    import duckdb  # only where a query is compared: a session needs none

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / name}.parquet')")
    return con


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v


def rows_of(pdf: pd.DataFrame, cols: list[str]) -> list[tuple]:
    rows = [tuple(cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(df, con, oracle: str) -> list[str]:
    result = con.sql(oracle)
    want = {c: KINDS.get(str(t), str(t)) for c, t in zip(result.columns, result.types)}
    got = dict(df.dtypes)
    if got != want and sorted(got.items()) != sorted(want.items()):
        return [f"schema: spark {sorted(got.items())} oracle {sorted(want.items())}"]
    cols = sorted(got)
    left, right = rows_of(df.toPandas(), cols), rows_of(result.df(), cols)
    if len(left) != len(right):
        return [f"rows: spark {len(left)} oracle {len(right)}", f"spark {left[:3]}", f"oracle {right[:3]}"]
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return [f"{len(bad)} of {len(left)} rows differ, first: {bad[0]}"] if bad else []


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = session(partitions=int(os.environ.get("PARTITIONS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problems, rows = differences(df, con, oracles[name]), "oracle"
            else:
                found = df.toPandas()
                problems, rows = ([] if len(found) else ["no rows"]), f"{len(found)} rows only"
                if wanted:
                    print(found.head(12).to_string())
        except Exception as e:  # report and go on with the next query
            problems, rows = [f"{type(e).__name__}: {str(e)[:700]}"], ""
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {rows}", *problems, sep="\n     " if problems else " ", flush=True)
        if problems:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
