"""Holds a query's rows against its SQL in DuckDB over the same tables."""

import datetime
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(value):
    """One form for a value of either engine; doubles to nine significant digits."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), Counter(tuple(plain(r[k]) for k in order) for r in rows)


def hold(spark, sf_dir, query, sql):
    """Raise AssertionError unless both give the same rows."""
    df = query(spark, sf_dir)
    done = connect(sf_dir).execute(sql)
    want_columns, want = rows_of([d[0] for d in done.description], done.fetchall())
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert columns == want_columns
    assert got == want, f"{sum((got - want).values())} rows more, {sum((want - got).values())} missing; {list((got - want))[:2]} for {list((want - got))[:2]}"
