"""Every registered query of the platform's own operators against its oracle, on the smallest tables."""

import numbers
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillspark.plans import registry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()


@pytest.fixture(scope="module")
def duck():
    if not SF.exists():
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def show(v) -> str:
        if v is None or v is pd.NA or v != v:
            return "-"
        return f"{float(v):.6f}" if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_) else str(v)

    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, str(SF)).toPandas()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0
