"""Run queries and their SQL checks side by side: `python tests/oracle_check.py [folder] [names…]`."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from threadhaul.queries import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return float(value)
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str) -> str | None:
    """What differs between the query and its check; None when nothing does."""
    result = QUERIES[name](spark, folder)
    got_names, got = result.columns, [tuple(row) for row in result.collect()]
    if name not in ORACLES:
        return None if got else "no rows"
    check = con.execute(ORACLES[name])
    want_names = [column[0] for column in check.description]
    want = check.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    mine, theirs = _rows(got_names, got), _rows(want_names, want)
    if mine == theirs:
        return None
    extra, missing = mine - theirs, theirs - mine
    return (
        f"{len(got)} rows != {len(want)}; only here {list(extra)[:2]}; only there {list(missing)[:2]}"
    )


if __name__ == "__main__":
    from threadhaul.runtime import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        begun = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28} {time.time() - begun:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{len(names)} queries, {bad} differ")
