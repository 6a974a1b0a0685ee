"""Spark vs DuckDB on sf0.001: every registered query of the library, in one connection."""

import pytest

from sluice.plans import registry
from tests.conftest import SF0001

registry.load_all()
NAMES = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def con(duck):
    return duck(SF0001)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _norm(v):
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "isoformat"):
        return str(v)
    return repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    df = registry.QUERIES[name](spark, SF0001)
    cols = df.columns
    got = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    res = con.execute(registry.ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == sorted(cols)
    dtypes = dict(zip(dcols, [str(t) for t in con.sql(registry.ORACLES[name]).types]))
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(st, st) == dtypes[f.name], (f.name, st, dtypes[f.name])
    idx = [dcols.index(c) for c in sorted(cols)]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == want
