"""Compare a plan with its SQL text on the same parquet tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 6)
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return _rows([d[0] for d in cursor.description], cursor.fetchall())


def difference(df, con, sql) -> str | None:
    names, got = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        extra = list(set(got) - set(want))[:3]
        missing = list(set(want) - set(got))[:3]
        return f"rows {len(got)} != {len(want)}; only spark {extra}; only sql {missing}; columns {names}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ; spark {bad[0][0]} sql {bad[0][1]}; columns {names}"
    kinds = [
        {type(v).__name__ for row in got for v in [row[i]] if v is not None} for i in range(len(names))
    ]
    want_kinds = [
        {type(v).__name__ for row in want for v in [row[i]] if v is not None} for i in range(len(names))
    ]
    if kinds != want_kinds:
        return f"types differ: {list(zip(names, kinds, want_kinds))}"
    return None if got else "no rows on either side"
