"""Rows of two frames, in any order and with columns sorted, as comparable tuples."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(p):
    p = p[sorted(p.columns)]
    return sorted(tuple("NULL" if not isinstance(v, list) and pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in p.itertuples(index=False))
