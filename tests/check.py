"""Compare registered queries with their SQL: ``python -m tests.check [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

from tests.session import local_session

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return format(value, "f")
    return value


def _bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    names = [columns[i] for i in order]
    return names, Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None if the DataFrame and the SQL give the same bag of rows."""
    got_names, got = _bag(df.columns, df.collect())
    cursor = con.execute(sql)
    want_names, want = _bag([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    if got != want:
        extra, lost = got - want, want - got
        return (
            f"rows {got.total()} / {want.total()}; only Spark {extra.total()}: "
            f"{list(extra)[:2]}; only SQL {lost.total()}: {list(lost)[:2]}"
        )
    return None if got else "empty"


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = [] if set(queries) == set(sqls) else [f"keys differ: {set(queries) ^ set(sqls)}"]
    for name in names:
        start = time.time()
        try:
            found = differences(queries[name](spark, sf_dir), con, sqls[name])
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:35s} {time.time() - start:6.2f}s {found or 'ok'}", flush=True)
        if found:
            bad.append(name)
    print("all equal" if not bad else f"FAILED: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
