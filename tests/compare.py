"""Runs a named query and its checking SQL on the same tables and compares the values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def checker(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "item"):
        return _cell(value.item())
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql, shown: int = 3) -> list[str]:
    names, mine = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    other_names, theirs = _rows([d[0] for d in cursor.description], cursor.fetchall())
    found = []
    if names != other_names:
        found.append(f"columns {names} against {other_names}")
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows against {len(theirs)}")
    if found:
        return found + [f"{mine[:shown]}", f"{theirs[:shown]}"]
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        cells = {n for a, b in wrong for n, x, y in zip(names, a, b) if x != y}
        found.append(f"{len(wrong)} rows differ in {sorted(cells)}")
        found += [f"{a}\n   {b}" for a, b in wrong[:shown]]
    kinds = {
        n: {type(v).__name__ for r in mine for v in [r[i]] if v is not None}
        ^ {type(v).__name__ for r in theirs for v in [r[i]] if v is not None}
        for i, n in enumerate(names)
    }
    found += [f"types of {n}: {sorted(k)}" for n, k in kinds.items() if k]
    return found
