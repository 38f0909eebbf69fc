"""Every register query against its SQL in DuckDB."""

import pytest
from conftest import rows

from ledgerloom.plans.registry import ORACLE_SQL, QUERIES


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    names = sorted(rel.columns)
    want = sorted((tuple(r) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall()), key=repr)
    have = rows(got)
    assert len(have) == len(want) and len(want) > 0
    assert all(near(x, y) for a, b in zip(have, want, strict=True) for x, y in zip(a, b, strict=True))


def test_export_has_all_rows(spark):
    sf = "/root/testdata/sf0.1"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert n > 100_000 and QUERIES["export_rows"](spark, sf).count() == n
