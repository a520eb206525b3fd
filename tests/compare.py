"""Spark results against DuckDB's on the same tables."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.7g}" if x else "0"
    if isinstance(x, (list, tuple)):
        return str([_value(y) for y in x])
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted("|".join(_value(r[i]) for i in order) for r in rows)


def same_rows(frame, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(frame.columns)
    a, b = _rows(frame.columns, [tuple(r) for r in frame.collect()]), _rows(columns, got.fetchall())
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
