"""Run registered queries next to their SQL and compare. ``python tests/check_oracle.py [dir] [name …]``"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def difference(con, sql: str, frame) -> str | None:
    """What differs between a query's rows and its SQL's rows, or nothing."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    types = {c[0]: str(c[1]).split("(")[0].upper() for c in result.description}
    for field in frame.schema.fields:
        if TYPES.get(field.dataType.simpleString()) != types[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} / {types[field.name]}"
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    if len(want) != len(got):
        return f"rows {len(got)} / {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{order}: {str(g)[:600]} / {str(w)[:600]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from leaksieve.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        begin = time.time()
        try:
            frame, sql = query(spark, sf_dir), entry.oracle_sql().get(name)
            problem = difference(con, sql, frame) if sql else None
            rows = frame.count()
        except Exception as error:
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name:28s} {rows:7d} {time.time() - begin:6.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
