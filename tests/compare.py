"""Order-free comparison of a Spark result and a DuckDB result."""

import math


def cell(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType") or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(round(float(x), 9) + 0.0)
    return str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(df, cursor):
    got = table(df.columns, [tuple(r) for r in df.collect()])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == b
