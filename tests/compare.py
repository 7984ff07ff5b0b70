"""Runs queries beside their SQL on the same files: python tests/compare.py [FOLDER] [NAME...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        source = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, bool):
            return str(v)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark, folder, name, f, sql):
    df = f(spark, folder)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    found = connect(folder).execute(sql)
    columns = [d[0] for d in found.description]
    theirs = canonical(found.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if ours == theirs:
        return None
    a, b = set(ours), set(theirs)
    return f"{len(ours)} / {len(theirs)} rows; ours only {sorted(a - b)[:3]}; SQL only {sorted(b - a)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from gleaner.session import get_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("compare", os.environ.get("COMPARE_MASTER", "local[8]"), spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    names, sql = sys.argv[2:], entry.oracle_sql()
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in sql:
                said = differences(spark, folder, name, f, sql[name]) or "ok"
            else:
                said = f"{len(f(spark, folder).collect())} rows, no SQL"
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:24} {time.time() - began:6.1f} s  {said[:900]}", flush=True)
