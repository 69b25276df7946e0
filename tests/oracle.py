"""Runs a registered query and its SQL equivalent and compares them as bags of rows."""

from __future__ import annotations

import datetime
import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (bool, type(None), str)):
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got_names, got = bag(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got)
    result = con.execute(sql)
    want_names, want = bag([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} against {want_names}", len(got)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {[r for r in got if r not in want][:2]} {[r for r in want if r not in got][:2]}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    types = [
        (n, type(a), type(b))
        for a, b in zip(got[:50], want[:50])
        for n, a, b in zip(got_names, a, b)
        if type(a) is not type(b)
    ]
    if bad:
        return f"{len(bad)} differ: {bad[:2]}", len(got)
    if types:
        return f"types {types[:3]}", len(got)
    return None, len(got)
