"""Comparison of results regardless of row and column order."""

import math


def canonical(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v)

    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(tuple(cell(r[k]) for k in at) for r in rows)


def of_spark(df):
    return canonical([tuple(r) for r in df.collect()], df.columns)


def of_duck(connection, sql):
    r = connection.execute(sql)
    return canonical(r.fetchall(), [d[0] for d in r.description])
