"""Run registered queries against their DuckDB SQL: python tests/oracle_check.py [name ...]"""

import math
import sys
import time
import warnings
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
warnings.filterwarnings("ignore")

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, Decimal)):
        return repr(float(x))
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    t0 = time.time()
    df = fn(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return "rows-only", len(mine[1]), t1 - t0, 0.0, ""
    cur = con.execute(sql)
    other = rows_of([c[0] for c in cur.description], cur.fetchall())
    t2 = time.time()
    if mine == other:
        return "match", len(mine[1]), t1 - t0, t2 - t1, ""
    detail = ""
    if mine[0] != other[0]:
        detail = f"columns {mine[0]} / {other[0]}"
    else:
        a, b = set(mine[1]), set(other[1])
        detail = f"rows {len(mine[1])}/{len(other[1])}\n   spark only {sorted(a - b)[:3]}\n   sql only   {sorted(b - a)[:3]}"
    return "DIFFERENT", len(mine[1]), t1 - t0, t2 - t1, detail


def main(argv):
    import __spark_entry__ as entry
    from wardlight.session import local_session

    folder = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    folder = next((a for a in argv if a.startswith("/")), folder)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            status, n, t_spark, t_sql, detail = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as exc:  # report and go on with the next query
            status, n, t_spark, t_sql, detail = "ERROR", 0, 0, 0, str(exc)[:700]
        if status in ("DIFFERENT", "ERROR"):
            bad.append(name)
        print(f"{status:10} {name:32} rows={n:<7} spark={t_spark:6.2f}s sql={t_sql:6.2f}s {detail}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
