"""Rows of a Spark frame and of a SQL result in one form."""

from __future__ import annotations


def value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([value(x) for x in v])
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{float(v):.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def of_spark(df):
    return rows(df.columns, df.collect())


def of_duck(con, sql):
    cursor = con.execute(sql)
    return rows([x[0] for x in cursor.description], cursor.fetchall())
