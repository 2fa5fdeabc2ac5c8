import os

import duckdb
import pandas as pd
import pytest

from tessera.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    out = df[cols].copy()
    for c in cols:
        if out[c].dtype.kind in "fiub":
            out[c] = out[c].astype(float) + 0.0
        else:
            out[c] = out[c].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v))
    return out.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(ORACLES[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_exact=False, rtol=1e-9, atol=1.1e-4)
