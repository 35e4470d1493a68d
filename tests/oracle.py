"""Run a query and its SQL side by side: row count, columns and an order-free value hash."""

from __future__ import annotations

import hashlib
import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def digest(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    lines = sorted(repr([plain(r[i]) for i in order]) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message, seconds)"""
    start = time.time()
    df = query(spark, sf_dir)
    names, rows = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"{len(rows)} rows, no SQL", took
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(want_names):
        return False, f"columns {sorted(names)} <> {sorted(want_names)}", took
    if len(rows) != len(want):
        return False, f"{len(rows)} rows <> {len(want)}", took
    got, got_lines = digest(names, rows)
    expected, want_lines = digest(want_names, want)
    if got != expected:
        gs, ws = set(got_lines), set(want_lines)
        return False, f"values: {sorted(gs - ws)[:2]} <> {sorted(ws - gs)[:2]}"[:900], took
    return True, f"{len(rows)} rows", took


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, message, took = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {message}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
