"""Run queries against their SQL on the same files: python -m checks.compare [sf] [name…]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks import base, load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        kind = out[c].dtype.kind
        if kind in "iub":
            out[c] = out[c].astype("int64")
        elif kind == "f":
            out[c] = out[c].round(6)
        else:
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else str(v))
    return out.sort_values(list(out.columns), kind="stable").reset_index(drop=True)


def compare(spark, con, sf: str, name: str) -> str:
    t = time.time()
    got = base.QUERIES[name](spark, sf)
    types = dict(got.dtypes)
    got = got.toPandas()
    spent = time.time() - t
    if name not in base.SQL:
        return f"rows  {name}: {len(got)} rows {spent:.1f}s"
    t = time.time()
    want = con.execute(base.SQL[name]).df()
    sql_spent = time.time() - t
    note = f"{len(got)} rows {spent:.1f}s sql {sql_spent:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL  {name}: columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"FAIL  {name}: rows {len(got)} / {len(want)}"
    a, b = canonical(got), canonical(want)
    kinds = [c for c in a.columns if a[c].dtype.kind != b[c].dtype.kind]
    if kinds:
        return f"FAIL  {name}: types {[(c, types[c], str(want[c].dtype)) for c in kinds]}"
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int((~same).idxmax())
            return f"FAIL  {name}: {(~same).sum()} differ in {c}, e.g. {a.iloc[i].to_dict()!s:.700} / {b.iloc[i].to_dict()!s:.700}"
    weak = " EMPTY" if len(got) == 0 else ""
    return f"ok    {name}: {note}{weak}"


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main(spark, sf: str, names: list[str]) -> int:
    load()
    con = connect(sf)
    bad = 0
    for name in [n for n in base.QUERIES if not names or any(n.startswith(p) for p in names)]:
        try:
            line = compare(spark, con, sf, name)
        except Exception as e:  # report and go on with the next query
            line = f"ERROR {name}: {type(e).__name__} {str(e)[:600]}"
        bad += line.startswith(("FAIL", "ERROR"))
        print(line, flush=True)
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    scale, wanted = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sys.exit(1 if main(session, f"/root/testdata/sf{scale}", wanted) else 0)
