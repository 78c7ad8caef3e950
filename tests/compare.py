"""Run registered queries next to their SQL in DuckDB and compare rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


SPENT = [0.0]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def family(name: str) -> str:
    name = name.lower()
    if name.startswith(("int", "bigint", "hugeint", "long", "smallint")):
        return "int"
    if name.startswith(("double", "float")):
        return "double"
    if name.startswith(("varchar", "string")):
        return "string"
    return name


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = df.select(*[f"`{c}`" for c in columns]).collect()
    SPENT[0] = time.time()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    for field in df.schema:
        a, b = family(field.dataType.simpleString()), family(kinds[field.name])
        if a != b:
            return f"type of {field.name}: {a} != {b}"
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    mine = Counter(tuple(plain(v) for v in row) for row in ours)
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        return (
            f"{sum(mine.values())} rows vs {sum(theirs.values())}; only spark {sum(extra.values())} e.g. "
            f"{list(extra)[:2]}; only sql {sum(missing.values())} e.g. {list(missing)[:2]}"
        )
    return None if ours else "no rows"


def main() -> None:
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as entry
    from vecloom.session import local_session

    spark, sf_dir = local_session(8), f"/root/testdata/sf{sf}"
    con, bad = duck(sf_dir), 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        start = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, queries[name], sqls[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
                result = None if n else "no rows"
        except Exception as error:  # a failing query must not hide the others
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += result is not None
        mark = "ok  " if result is None else "FAIL"
        print(f"{mark} {name:28s} {SPENT[0] - start if name in sqls else time.time() - start:6.2f}s {'' if name in sqls else '(rows only)'} {result or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
