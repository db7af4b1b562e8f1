"""Rows of a query against rows of SQL, in any order."""

from __future__ import annotations


def plain(v: object) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return repr(round(v + 0.0, 9))
    return str(v)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(relation) -> tuple[list[str], list[tuple]]:
    names = relation.columns
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
