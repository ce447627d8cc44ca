"""Run registered queries in Spark and in DuckDB and compare whole results.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if hasattr(value, "item"):
        return _cell(value.item())
    return repr(value)


def _kind(dtype: str) -> str:
    d = dtype.lower()
    return {
        "integer": "int",
        "varchar": "string",
        "bool": "boolean",
    }.get(d, d)


def compare(spark, con, folder: str, name: str, build, sql: str | None) -> tuple[str, int, float]:
    started = time.time()
    result = build(spark, folder)
    columns = sorted(result.columns)
    got = [tuple(_cell(r[c]) for c in columns) for r in result.collect()]
    took = time.time() - started
    if sql is None:
        return ("rows-only" if got else "EMPTY", len(got), took)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: _kind(str(d[1])) for d in cursor.description}
    rows = cursor.fetchall()
    if sorted(names) != columns:
        return (f"COLUMNS {columns} vs {sorted(names)}", len(got), took)
    spark_types = {c: _kind(t) for c, t in result.dtypes}
    if spark_types != types:
        diff = {c: (spark_types[c], types[c]) for c in columns if spark_types[c] != types[c]}
        return (f"TYPES spark/duck {diff}", len(got), took)
    index = [names.index(c) for c in columns]
    want = [tuple(_cell(r[i]) for i in index) for r in rows]
    if len(got) != len(want):
        return (f"ROWS {len(got)} vs {len(want)}", len(got), took)
    got.sort()
    want.sort()
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return (f"VALUES {len(bad)} differ; {columns} e.g. {bad[0]}", len(got), took)
    return ("ok" if got else "EMPTY", len(got), took)


def main() -> None:
    from loomframe.session import local_session

    import __spark_entry__ as entry

    folder = sys.argv[1]
    spark = local_session("8")
    con = connect(folder)
    sqls, builds = entry.oracle_sql(), entry.queries()
    names = [n for n in builds if not sys.argv[2:] or any(a in n for a in sys.argv[2:])]
    bad = 0
    for name in names:
        try:
            status, rows, took = compare(spark, con, folder, name, builds[name], sqls.get(name))
        except Exception as error:  # a report line per query, then go on
            status, rows, took = f"ERROR {type(error).__name__}: {str(error)[:600]}", -1, 0.0
        bad += status not in ("ok", "rows-only")
        print(f"{name:32s} {rows:8d} {took:6.2f}s  {status}", flush=True)
    print(f"{len(names)} queries, {bad} not ok")


if __name__ == "__main__":
    main()
