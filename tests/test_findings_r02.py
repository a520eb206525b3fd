"""Queries on small tables where they once differed from their SQL."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quillmere.plans.registry import ORACLE_SQL, QUERIES


def _both(spark, tmp_path, name, table, parts):
    """The query's rows and its SQL's, on one thread, over a table of several files."""
    (tmp_path / f"{table}.parquet").mkdir()
    for i, part in enumerate(parts):
        pq.write_table(part, tmp_path / f"{table}.parquet" / f"part-{i}.parquet")
    frame = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET threads=1")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted((tuple(r) for r in frame.collect()), key=key), sorted(want, key=key)


def _events(rows):
    """Rows of (event_id, hour, user_id, value)."""
    ids, hours, users, values = zip(*rows)
    ts = [datetime(2024, 1, 1) + timedelta(hours=h, minutes=5) for h in hours]
    return pa.table({"event_id": pa.array(ids, pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": ["view"] * len(ids), "value": pa.array(values, pa.float64()), "props": ["{}"] * len(ids)})


def test_acrophase_adds_in_the_order_of_the_table(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is over 0.6 in this order and 0.6 where the first file is added last; a row without user is nobody's."""
    parts = [_events([(0, 5, 1, 0.1)]), _events([(1, 5, 1, 0.2), (2, 5, 1, 0.3), (3, 2, 1, 0.3), (4, 2, 1, 0.3), (5, 7, None, 1.0)])]
    got, want = _both(spark, tmp_path, "acrophase", "events", parts)
    assert got == want == [(1, 5)]


def test_age_on_leap_days_and_before_birth(spark, tmp_path):
    """Born on 29 February 1964: a year is whole on 1 March, or on the 29th. An order before birth counts years down from 0."""
    born = 1383  # days from 1960-05-17 to 1964-02-29
    dates = [datetime(1993, 2, 28), datetime(1993, 3, 1), datetime(1996, 2, 28), datetime(1996, 2, 29), datetime(1963, 12, 1), datetime(1961, 2, 28), datetime(1961, 3, 1), None]
    orders = pa.table({"o_orderkey": pa.array(range(len(dates) + 1), pa.int64()), "o_custkey": pa.array([born] * len(dates) + [None], pa.int64()), "o_orderdate": pa.array([*dates, datetime(1993, 2, 28)], pa.timestamp("us"))})
    got, want = _both(spark, tmp_path, "age_at_sample", "orders", [orders])
    assert got == want and dict(got) == {0: 28, 1: 29, 2: 31, 3: 32, 4: 0, 5: -3, 6: -2, 7: None, 8: None}


def test_hash_split_shares_are_exact(spark, tmp_path):
    """0.7 of 90 users are 63, though 90 * 0.7 is under 63 in doubles; a null user is one of them and the last."""
    got, want = _both(spark, tmp_path, "hash_split", "events", [_events([(i, i, i or None, 1.0) for i in range(90)])])
    splits = [s for _, s in got]
    assert got == want and [splits.count(s) for s in ("train", "validation", "test")] == [63, 9, 18] and dict(got)[None] == "test"
