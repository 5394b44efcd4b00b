"""Compare registered queries with their check SQL: python tests/oracle_check.py [sf] [prefix ...]"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from tickloom.session import build_session  # noqa: E402


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(_plain(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def _plain(v):
    import datetime

    import numpy as np

    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(v)
    if isinstance(v, datetime.date):
        return str(pd.Timestamp(v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return [_plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    spark = build_session("check", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    oracles, bad, none = entry.oracle_sql(), [], []
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or name.startswith(w + "_") or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            got = df.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(e).__name__} {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time() - t
        if name not in oracles:
            none.append(name)
            print(f"rows {name}: {len(got)} ({t1:.1f}s)", flush=True)
            continue
        t = time.time()
        try:
            cur = con.execute(oracles[name])
            types = {d[0]: str(d[1]) for d in cur.description}
            want = cur.df()
            raw = con.execute(oracles[name]).fetchall()
            want = pd.DataFrame(raw, columns=list(types), dtype=object)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: sql {str(e)[:700]}", flush=True)
            bad.append(name)
            continue
        t2 = time.time() - t
        got = pd.DataFrame([list(r) for r in df.collect()], columns=df.columns, dtype=object) if len(got) else got
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
        odd = [f"{c}:{kinds[c]}/{types.get(c)}" for c in kinds if c in types and same.get(kinds[c]) and not types[c].startswith(same[kinds[c]]) ]
        if sorted(got.columns) != sorted(want.columns):
            print(f"FAIL {name}: columns {sorted(set(got.columns) ^ set(want.columns))}", flush=True)
            bad.append(name)
            continue
        a, b = normal(got), normal(want)
        if len(a) != len(b) or (len(a) and not a.equals(b)) or odd:
            bad.append(name)
            print(f"FAIL {name}: rows {len(a)}/{len(b)} types {odd}", flush=True)
            if len(a) == len(b):
                diff = [(c, int((a[c] != b[c]).sum())) for c in a.columns if not a[c].equals(b[c])]
                print("   cols", diff)
            ex = pd.merge(a.astype(object).astype(str), b.astype(object).astype(str), how="outer", indicator=True)
            for side in ("left_only", "right_only"):
                for r in ex[ex._merge == side].drop(columns="_merge").head(2).to_dict("records"):
                    print("  ", side, r)
        else:
            print(f"ok   {name}: {len(a)} rows ({t1:.1f}s / {t2:.1f}s){' EMPTY' if not len(a) else ''}", flush=True)
    print("bad:", bad, "no sql:", none)


if __name__ == "__main__":
    main()
