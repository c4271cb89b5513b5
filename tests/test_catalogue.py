"""Every registered query against its SQL on an independent engine."""

import math
import os

import duckdb
import pytest

from rulesieve.plans.catalogue import ORACLES, QUERIES


def value(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, (bool, int)):
        return x
    return round(x, 9) if isinstance(x, float) and not math.isinf(x) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(value, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got) > 0
