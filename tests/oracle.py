"""Run a registered query and its SQL side by side on the same Parquet files."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, query, sf_dir: str, connection=None) -> str | None:
    """None if both sides agree exactly, else what differs."""
    df = query.run(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if query.sql is None:
        return None if got else "no rows"
    cursor = (connection or duck(sf_dir)).execute(query.sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:1]} / {want[:1]}"
    for a, b in zip(got, want):
        if a != b:
            bad = sum(x != y for x, y in zip(got, want))
            return f"{bad} rows differ, first:\n   spark {a}\n   sql   {b}"
    return None if got else "no rows"


if __name__ == "__main__":
    from tiltmeter.plans.registry import QUERIES, load_all
    from tiltmeter.session import build_session

    import importlib

    sf = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    only = [w for w in wanted if w.endswith("_queries")]
    wanted = [w for w in wanted if not w.endswith("_queries")]
    for module in only:
        importlib.import_module(f"tiltmeter.plans.{module}")
    if not only:
        load_all()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    for name, q in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            result = compare(spark, name, q, sf, con)
        except Exception as error:  # noqa: BLE001 - report and go on
            result = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - begin:.1f}s {result or ''}", flush=True)
