"""Comparison of a Spark query with its SQL in DuckDB."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return format(value, ".9g")
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(str([plain(r[n]) for n in names]) for r in df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(str([plain(r[k]) for k in order]) for r in cursor.fetchall())
