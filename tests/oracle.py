"""Compare registered queries with their SQL, run by DuckDB on the same files.

    python tests/oracle.py [folder] [query …]
"""

import datetime
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _plain(v):
    if isinstance(v, float):
        return None if v != v else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, folder, name, fn, sql):
    started = time.time()
    df = fn(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return f"rows={len(got[1])}", took, True
    started = time.time()
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    note = f"rows={len(got[1])} sql={time.time() - started:.1f}s"
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", took, False
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} != {len(want[1])}", took, False
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return f"VALUES {len(bad)} differ, e.g. {bad[0][0]} != {bad[0][1]}", took, False
    return note, took, True


def main():
    import __spark_entry__ as e
    from veilframe.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("oracle", master="local[8]", shuffle_partitions=8, **{
        "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls, failed = e.oracle_sql(), []
    todo = {n: f for n, f in e.queries().items() if not args or n in args}
    for name, fn in todo.items():
        try:
            note, took, ok = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as ex:  # report and go on with the next query
            note, took, ok = f"ERROR {type(ex).__name__}: {str(ex)[:1200]}", 0.0, False
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name:28s} {'' if sqls.get(name) else '(no sql) '}{note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(todo) - len(failed)}/{len(todo)} ok; failed: {failed}")
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
