"""Run a registered query and its check SQL on the same tables and compare all values."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry
from pagemill.plans.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


def spark_rows(spark, name: str, sf_dir: str):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle_rows(con, name: str):
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in res.fetchall()), key=repr)
