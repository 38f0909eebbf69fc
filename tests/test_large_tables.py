"""Queries with their tables dealt as large ones are."""

import re

import duckdb
import pytest
from conftest import TABLES, rows
from test_register_queries import near

from ledgerloom import session
from ledgerloom.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture
def large(monkeypatch):
    """Small tables take the way of large ones: more partitions than the session's own number."""
    monkeypatch.setattr(session, "EACH", 1 << 14)


def final_plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["category_and_year", "contract_number_prefix", "details_with_recovery", "yearly_spending", "family_scan", "family_members", "family_representatives", "export_detailed"])
def test_dealt_rows_same_as_sql(spark, sf, duck, large, name):
    got = QUERIES[name](spark, sf)
    plan = final_plan(got)
    assert "REPARTITION_BY_NUM" in plan
    assert not re.search(r"BroadcastHashJoin \[(l_partkey|o_custkey|l_orderkey)", plan)  # no growing table is broadcast
    rel = duck.sql(ORACLE_SQL[name])
    names = sorted(rel.columns)
    want = sorted((tuple(r) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall()), key=repr)
    have = rows(got)
    assert len(have) == len(want) > 0 and all(near(x, y) for a, b in zip(have, want, strict=True) for x, y in zip(a, b, strict=True))


def test_dealt_export_keeps_its_order(spark, sf, large):
    got = [(r["award_date"], r["contract_number"]) for r in QUERIES["export_detailed"](spark, sf).collect()]
    assert [d for d, _ in got] == sorted((d for d, _ in got), reverse=True)


def test_canonical_step_is_generated_in_pieces(spark, sf):
    """The step that reads the text columns is no part of a whole-stage method, which the JVM would not compile."""
    plan = QUERIES["canonical_records"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(award_date" in plan


def test_strip_takes_all_white_space(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.text import strip

    texts = [chr(c) + "a" + chr(c) for c in [*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF] if c] + [" \t　", "", "a b\n \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0


@pytest.fixture(scope="module")
def shared_numbers(sf, tmp_path_factory):
    """Tables whose order keys have seven digits, so that ten orders share a contract number; two nations, two years."""
    folder = tmp_path_factory.mktemp("shared")
    change = {"orders": "o_orderkey + 1000000 AS o_orderkey, TIMESTAMP '1995-03-01' + INTERVAL (o_orderkey % 2 * 365) DAY AS o_orderdate", "lineitem": "l_orderkey + 1000000 AS l_orderkey", "customer": "c_nationkey % 2 AS c_nationkey"}
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (SELECT * {f'REPLACE ({change[t]})' if t in change else ''} FROM '{sf}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["detail_checks", "enriched_records", "target_outcomes", "recovered_records"])
def test_targets_that_share_their_number(spark, shared_numbers, name):
    folder, con = shared_numbers
    got, rel = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
    names = sorted(rel.columns)
    want = sorted((tuple(r) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall()), key=repr)
    assert rows(got) == want and len(want) > 0


@pytest.mark.parametrize("name", ["seeded_targets", "seeded_targets_spelled", "seed_counts"])
def test_seeding_scans_its_families_once(spark, sf, name):
    """Targets, tracking file and seeding read one scan; none of them makes the contracts again."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
