"""Run registered queries next to their oracles: python tests/compare.py SF [name ...]."""

from __future__ import annotations

import glob
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

ROOT = "/root/testdata"


def oracle_connection(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values comparable across engines, rows sorted."""
    out = pdf[sorted(pdf.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = out[c].astype("datetime64[us]")
        elif pd.api.types.is_numeric_dtype(out[c]) and not pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype(float)
        else:
            out[c] = out[c].where(out[c].notna(), None).astype(object)
    return out.sort_values(list(out.columns), key=lambda s: s.astype(str) if s.dtype == object else s,
                           ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    got, want = normal(got), normal(want)
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} vs {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype == float and b.dtype == float:
            same = (a.to_numpy() == b.to_numpy()) | (a.isna() & b.isna()).to_numpy()
        else:
            same = np.array([(x is None and y is None) or x == y for x, y in zip(a, b)], dtype=bool)
        if not same.all():
            i = int(np.argmin(same))
            return f"column {c}: {int((~same).sum())} differ, first {a[i]!r} vs {b[i]!r}"
    return None


def main(sf: str, names: list[str]) -> int:
    from pvseries.queries import QUERIES
    from pvseries.session import local_session

    spark, folder = local_session(8), f"{ROOT}/{sf}"
    con, bad = oracle_connection(folder), 0
    for name, q in QUERIES.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = q(spark, folder).toPandas()
            took = time.time() - start
            if q.sql is None:
                verdict = f"rows only ({len(got)})" if len(got) else "EMPTY"
            else:
                verdict = difference(got, con.execute(q.sql).df()) or "ok"
        except Exception as e:  # keep going, report at the end
            took, verdict = time.time() - start, f"ERROR {str(e)[:400]}"
        bad += not (verdict == "ok" or verdict.startswith("rows only"))
        print(f"{name:26s} {took:6.2f}s {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
