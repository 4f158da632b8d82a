"""Runs registered queries against their SQL in DuckDB. Also a script:

    python tests/agreement.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        if math.isnan(number):
            return "nan"
        return repr(number + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return str(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(canonical(r[i]) for i in order) for r in rows])


def compare(spark, con, fn, sql: str, sf_dir: str):
    df = fn(spark, sf_dir)
    got_names, got = sorted_rows(df.columns, df.collect())
    res = con.execute(sql)
    want_names, want = sorted_rows([d[0] for d in res.description], res.fetchall())
    problems = []
    if got_names != want_names:
        problems.append(f"columns {got_names} / {want_names}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} / {len(want)}")
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(diff)} rows differ, first {diff[:2]}")
    return len(got), problems


def main() -> int:
    from gaugework.plans.all import ORACLE_SQL, QUERIES
    from gaugework.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session("agreement"), connect(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            if name in ORACLE_SQL:
                n, problems = compare(spark, con, QUERIES[name], ORACLE_SQL[name], sf_dir)
            else:
                n, problems = QUERIES[name](spark, sf_dir).count(), ["(no SQL)"]
        except Exception as e:  # noqa: BLE001
            n, problems = -1, ["".join(traceback.format_exception_only(e))[:700]]
        bad += bool(problems) and problems != ["(no SQL)"]
        print(f"{name:32s} {n:7d} rows {time.time() - t:6.1f}s {' '.join(problems) or 'ok'}", flush=True)
    print(f"{bad} of {len(names)} disagree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
