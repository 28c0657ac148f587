"""Compare a registered query with its SQL on DuckDB, as sets of rows with doubles rounded."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def assert_same(df, sql, con=None):
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = (con or connect()).execute(sql)
    names = [d[0] for d in result.description]
    want = sorted(str([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert sorted(names) == columns
    assert got == want
