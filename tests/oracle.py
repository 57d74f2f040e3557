"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def kind(v):
    if v is None:
        return None
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), type(v).__name__)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((x is None, str(kind(x)), x if x is not None else 0) for x in r))
    return [columns[i] for i in order], out


def compare(df, sql, con):
    """Return (ok, message)."""
    t0 = time.time()
    got = df.collect()
    t1 = time.time()
    gcols, grows = rows_of(list(df.columns), [tuple(r) for r in got])
    if sql is None:
        return len(got) > 0, f"rows={len(got)} spark={t1-t0:.2f}s (no oracle)"
    cur = con.execute(sql)
    ecols = [c[0] for c in cur.description]
    expected = cur.fetchall()
    t2 = time.time()
    ecols, erows = rows_of(ecols, expected)
    info = f"rows={len(grows)} spark={t1-t0:.2f}s duck={t2-t1:.2f}s"
    if gcols != ecols:
        return False, f"columns differ: {gcols} vs {ecols}"
    if len(grows) != len(erows):
        return False, f"row count {len(grows)} vs {len(erows)}; {grows[:3]} vs {erows[:3]}"
    for j, c in enumerate(gcols):
        gk = {kind(r[j]) for r in grows} - {None}
        ek = {kind(r[j]) for r in erows} - {None}
        if gk != ek:
            return False, f"type of {c}: {gk} vs {ek}"
    bad = [(g, e) for g, e in zip(grows, erows) if g != e]
    if bad:
        return False, f"{len(bad)} of {len(grows)} rows differ {gcols}: {bad[:2]}"
    return True, info


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from cohortry.session import local_session

    sf = "/root/testdata/sf0.01"
    names = argv[1:]
    if names and names[0].startswith("/"):
        sf = names.pop(0)
    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    fails = 0
    for q in qs:
        if names and not any(q.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            ok, msg = compare(qs[q](spark, sf), sqls.get(q), con)
        except Exception as exc:  # report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        fails += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {q} total={time.time()-t0:.2f}s {msg}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main(sys.argv)
