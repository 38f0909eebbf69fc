"""What the register queries share: the contracts view and its SQL, and the registry of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import parse, text
from ledgerloom.sources.contracts import contracts

VIEW = f"""
v AS (SELECT
  CAST(l.l_orderkey * 100 + row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
    l.l_shipdate, l.l_extendedprice, l.l_quantity, l.l_discount, l.l_tax) AS BIGINT) AS id,
  concat(CAST(year(o.o_orderdate) AS VARCHAR), '-', lpad(CAST(l.l_orderkey AS VARCHAR), 6, '0')) AS contract_number,
  n.n_name AS entity, CAST(c.c_nationkey AS VARCHAR) AS entity_number,
  concat(c.c_name, CASE l.l_linenumber % 5 WHEN 0 THEN ', INC.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' L.L.C.' WHEN 3 THEN ' Corp.' ELSE '' END) AS contractor,
  CASE WHEN l.l_linenumber = 1 THEN '' WHEN l.l_linenumber = 7 AND l.l_orderkey % 10 = 0 THEN 'ORIGINAL' ELSE substr('ABCDEF', l.l_linenumber - 1, 1) END AS amendment,
  p.p_type AS service_category, p.p_name AS service_type, l.l_extendedprice AS amount, CAST(0.0 AS DOUBLE) AS amount_receivable,
  CAST(l.l_shipdate AS DATE) AS award_date, CAST(l.l_shipdate AS DATE) AS valid_from, CAST(l.l_shipdate + INTERVAL '90' DAY AS DATE) AS valid_to,
  o.o_orderpriority AS procurement_method, c.c_mktsegment AS fund_type, CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS cancelled,
  CAST(year(l.l_shipdate - INTERVAL '6' MONTH) AS VARCHAR) || '-' || CAST(year(l.l_shipdate - INTERVAL '6' MONTH) + 1 AS VARCHAR) AS fiscal_year,
  'csv' AS source_type
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN part p ON p.p_partkey = l.l_partkey),
c AS (SELECT v.*, {text.family_sql('contractor')} AS family FROM v)"""
ORIGINAL = "(upper(trim(amendment)) IN ('', 'ORIGINAL'))"
MONEY = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) AS {1}"
RANK = "row_number() OVER (PARTITION BY contract_number, entity, family ORDER BY CASE WHEN {0} THEN 0 ELSE 1 END, award_date NULLS FIRST, id)"


REP_SQL = ("id", "amount", "award_date", "contractor", "fiscal_year", "service_type", "cancelled", "service_category", "valid_from", "valid_to", "procurement_method", "fund_type")


def rollup_sql(name: str, original: str) -> str:
    return f"""{name}r AS (SELECT *, {original} AS orig, {RANK.format(original)} AS rn FROM c),
{name} AS (SELECT contract_number, entity, family, count(*) AS family_size, {MONEY.format('amount', 'total')}, CAST(max(CAST(orig AS INT)) AS INT) AS has_original,
  min(award_date) AS earliest, """ + ", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS rep_{c}" for c in REP_SQL) + f" FROM {name}r GROUP BY contract_number, entity, family)"


FAMILIES, BOARD = rollup_sql("f", ORIGINAL), rollup_sql("b", "(trim(amendment) = '')")
SCAN = f"""s AS (SELECT upper(contract_number) AS number_key, upper(entity) AS entity_key, family, count(*) AS row_count, CAST(max(CAST({ORIGINAL} AS INT)) AS INT) AS has_original,
  arg_min(contract_number, (award_date, id)) AS contract_number, arg_min(entity, (award_date, id)) AS entity, arg_min(contractor, (award_date, id)) AS contractor, arg_min(fiscal_year, (award_date, id)) AS recovery_batch, arg_min(id, (award_date, id)) AS rep_id
  FROM c GROUP BY ALL)"""
SCAN = SCAN.replace("(award_date, id)", "row(award_date, id)")
TARGETS = SCAN + """, m AS (SELECT * FROM s WHERE row_count > 1 AND has_original = 0),
t AS (SELECT contract_number, entity, contractor, family, recovery_batch, ['auto_discover', 'manual_url', 'auto_discover', 'guess'][CAST(rep_id % 4 + 1 AS INT)] AS lookup_mode,
  CASE WHEN rep_id % 4 = 1 THEN 'https://example.org/contract' END AS source_url, ['pending', 'recovered', 'unrecoverable', 'ambiguous'][CAST(rep_id % 4 + 1 AS INT)] AS status,
  CASE WHEN rep_id % 4 = 2 THEN 'no candidate' END AS notes, rep_id AS position FROM m)"""
HASH = """substr(sha256(concat_ws('|', contract_number, entity, contractor, amendment, CAST(award_date AS VARCHAR), CASE WHEN amount = 0 THEN '' ELSE CAST(amount AS VARCHAR) END)), 1, 16)"""
DOUBLE = f"""h AS (SELECT *, {HASH} AS row_hash FROM c),
d AS (SELECT *, 'b.csv' AS file FROM h UNION ALL SELECT *, 'a.csv' AS file FROM h),
w AS (SELECT *, row_number() OVER (PARTITION BY row_hash ORDER BY file, id) AS rn FROM d)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str, *parts: str):
    """Register a function of contracts; ``parts``: named sub-queries that its SQL needs."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(contracts(spark, sf_dir))
        ORACLE_SQL[name] = f"WITH {', '.join([VIEW, *parts])} {sql}"
        return f

    return add


def by_hash(rows):
    """The rows with their content hash."""
    return rows.withColumn("row_hash", parse.row_hash(*(F.col(c) for c in ("contract_number", "entity", "contractor", "amendment", "award_date", "amount"))))


def loaded_twice(rows):
    """All rows in a first file, and again in a second one."""
    files = F.explode(F.array(F.lit("a.csv"), F.lit("b.csv")))
    return by_hash(rows).withColumns({"source_rank": F.lit(0), "pos": F.col("id")}).withColumn("file", files)


