"""Queries of loading and publishing: ids, change reports, calendars, exports, printed lists, manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import dashboard, families, loading, recovery, rollup_store, search, store
from ledgerloom.plans.base import BOARD, DOUBLE, FAMILIES, MONEY, TARGETS, by_hash, loaded_twice, register
from ledgerloom.plans.search_queries import SUMMARY_SQL
from ledgerloom.session import checkpoint_dir, release, written
from ledgerloom.sources.contracts import TARGET, canonical, raw_text

register("load_ids", "SELECT row_number() OVER (ORDER BY file, id) AS load_id, id, file FROM d", DOUBLE)(
    lambda c: loading.load_ids(loaded_twice(c)).select(F.col("id").alias("load_id"), F.col("pos").alias("id"), "file")
)
register(
    "appended_sources",
    "SELECT source_type, count(*) AS n, min(id) AS first_id FROM (SELECT id, 'csv' AS source_type FROM c UNION ALL SELECT id, 'live_recovery' FROM c WHERE trim(amendment) = '') GROUP BY source_type",
)(lambda c: canonical(raw_text(c).withColumn("source_type", F.lit("csv")), keep=("id",)).unionByName(
    canonical(raw_text(c.where("trim(amendment) = ''")).withColumn("source_type", F.lit("live_recovery")), keep=("id",))
).groupBy("source_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id")))
register(
    "appended_rows",
    """SELECT id, 'csv' AS source_type, contract_number, entity, award_date, amount, cancelled FROM c UNION ALL SELECT id, 'live_recovery', contract_number, entity, award_date, amount, cancelled FROM c WHERE trim(amendment) = ''""",
)(lambda c: canonical(raw_text(c).withColumn("source_type", F.lit("csv")), keep=("id",)).unionByName(
    canonical(raw_text(c.where("trim(amendment) = ''")).withColumn("source_type", F.lit("live_recovery")), keep=("id",))
).select("id", "source_type", "contract_number", "entity", "award_date", "amount", "cancelled"))


def as_stored(c):
    """Rows as an older table holds them: dates as text in several styles, amendments with blanks."""
    text = lambda d: F.when(F.col("id") % 3 == 0, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return c.select("id", *(text(d).alias(d) for d in ("award_date", "valid_from", "valid_to")), F.when(F.col("id") % 7 == 0, F.concat(F.lit(" "), "amendment")).otherwise(F.nullif("amendment", F.lit(""))).alias("amendment"))


register(
    "change_report",
    """SELECT * FROM (SELECT id, """ + ", ".join(f"CASE WHEN id % 3 = 0 THEN strftime({d}, '%m/%d/%Y') ELSE CAST({d} AS VARCHAR) END AS {d}_before, CAST({d} AS VARCHAR) AS {d}_after" for d in ("award_date", "valid_from", "valid_to"))
    + """, CASE WHEN id % 7 = 0 THEN ' ' || amendment ELSE nullif(amendment, '') END AS amendment_before, nullif(amendment, '') AS amendment_after FROM c) WHERE id % 3 = 0 OR id % 7 = 0""",
)(lambda c: loading.change_report(as_stored(c)))
register(
    "rewritten_rows",
    "SELECT id, CAST(award_date AS VARCHAR) AS award_date, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, nullif(amendment, '') AS amendment FROM c",
)(lambda c: loading.rewritten(as_stored(c)))
register(
    "year_calendar",
    """SELECT y.fiscal_year, y.archive_only, y.known_absent, coalesce(n, 0) AS n FROM (SELECT CAST(y AS VARCHAR) || '-' || CAST(y + 1 AS VARCHAR) AS fiscal_year, y IN (2010, 2011) AS archive_only, y = 2023 AS known_absent FROM range(1990, 2026) r(y)) y
      LEFT JOIN (SELECT fiscal_year, count(*) AS n FROM c GROUP BY fiscal_year) c ON c.fiscal_year = y.fiscal_year""",
)(lambda c: loading.calendar(c.sparkSession, 2025, 1990).join(c.groupBy("fiscal_year").agg(F.count("*").alias("n")), "fiscal_year", "left").fillna(0, ["n"]))
register("refresh_years", "SELECT CAST(y AS VARCHAR) || '-' || CAST(y + 1 AS VARCHAR) AS fiscal_year FROM range(2010, 2026) r(y) WHERE y >= (SELECT max(CAST(left(fiscal_year, 4) AS INT)) FROM c)")(
    lambda c: loading.refresh_years(c.select("fiscal_year").distinct(), 2025)
)
register("rows_since_cursor", "SELECT id, award_date FROM c WHERE award_date >= DATE '1998-08-01'")(lambda c: loading.since(c, last_success="1998-08-01").select("id", "award_date"))
register("rows_since_a_week", "SELECT id, award_date FROM c WHERE award_date >= DATE '1998-07-25'")(lambda c: loading.since(c, today="1998-08-01").select("id", "award_date"))
register(
    "new_row_digest",
    """SELECT id, entity, contractor, CASE WHEN amount = 0 THEN 'N/A' ELSE '$' || format('{:,.2f}', amount) END AS amount_text, award_date, contract_number, greatest((SELECT count(*) FROM c WHERE award_date >= DATE '1998-06-01') - 50, 0) AS more
      FROM c WHERE award_date >= DATE '1998-06-01' ORDER BY id LIMIT 50""",
)(lambda c: loading.digest(c.where("award_date >= '1998-06-01'")))
NULLS = "CAST(NULL AS VARCHAR)"
DETAILED_SQL = f"""contract_number, amendment, contractor, entity, entity_number, amount, amount_receivable, award_date, valid_from, valid_to, service_category, service_type, fiscal_year, procurement_method, fund_type,
  {NULLS} AS pco_number, cancelled, {NULLS} AS document_url, source_type, {NULLS} AS source_contract_id, {NULLS} AS source_url"""
register(
    "export_summary",
    f"SELECT contract_number, contractor, entity, amount, award_date, valid_from, valid_to, service_category, service_type, fiscal_year, family_size, family_total_amount, procurement_method, fund_type FROM ({SUMMARY_SQL})",
    FAMILIES,
)(lambda c: loading.exported(families.summaries(families.rollup(c)), "summary"))
register("export_detailed", f"SELECT {DETAILED_SQL} FROM c")(lambda c: loading.exported(c, "detailed"))
register("export_detailed_filtered", f"SELECT {DETAILED_SQL} FROM c WHERE fiscal_year = '1996-1997' AND starts_with(contract_number, '1996-0000')")(
    lambda c: loading.export(search.filtered(c, {"fiscal_year": "1996-1997", "contract_number": "1996-0000"}), "detailed")
)
PRINTED = "'$' || format('{:,.2f}', amount) AS amount, " + ", ".join(f"strftime({d}, '%B %-d, %Y') AS {d}" for d in ("award_date", "valid_from", "valid_to"))
register("printed_summary", f"SELECT contract_number, contractor, entity, {PRINTED}, service_category FROM ({SUMMARY_SQL})", FAMILIES)(
    lambda c: loading.for_print(loading.exported(families.summaries(families.rollup(c)), "summary"), "summary")
)
register("printed_detailed", f"SELECT contract_number, amendment, contractor, entity, {PRINTED}, service_type, source_type, {NULLS} AS source_contract_id, {NULLS} AS source_url FROM c")(
    lambda c: loading.for_print(loading.exported(c, "detailed"), "detailed")
)


def shown_rows(source: str, name: str, order: str) -> str:
    """The rows of a list of the manifest as JSON."""
    return f"""(SELECT '[' || string_agg('{{"{name}":' || to_json({name}) || ',"family_count":' || CAST(families AS VARCHAR) || ',"total_amount":' || CAST(CAST(money AS DECIMAL(18,2)) AS VARCHAR) || '}}', ',' ORDER BY {order}) || ']' FROM ({source}))"""


def board_sql(key: str, name: str, where: str, limit: str = "") -> str:
    return f"SELECT {key} AS key, {name} AS {'fiscal_year' if key == 'rep_fiscal_year' else 'name'}, count(*) AS families, {MONEY.format('total', 'money')} FROM b WHERE {where} GROUP BY {key} {limit}"


def manifest_sql(years: tuple[str, ...] = ()) -> str:
    among = f" AND rep_fiscal_year IN ({', '.join(map(repr, years))})" if years else ""
    listed = "[" + ",".join(f'"{y}"' for y in years) + "]"
    held = f"'{listed}'" if years else "(SELECT '[' || string_agg('\"' || fiscal_year || '\"', ',' ORDER BY fiscal_year DESC) || ']' FROM (SELECT DISTINCT fiscal_year FROM c))"
    top, down = "ORDER BY money DESC, families DESC, key LIMIT 5", "money DESC, families DESC, key"
    contractors = shown_rows(board_sql("family", "max(rep_contractor)", "family <> ''" + among, top), "name", down)
    entities = shown_rows(board_sql("entity", "entity", "trim(entity) <> ''" + among, top), "name", down)
    yearly = shown_rows(board_sql("rep_fiscal_year", "rep_fiscal_year", "trim(rep_fiscal_year) <> ''" + among), "fiscal_year", "key")
    fields = " || ',' || ".join(f"'\"{x}\":' || coalesce(CAST(to_json({x}) AS VARCHAR), 'null')" for x in TARGET)
    return f"""SELECT 0 AS section, CAST(0 AS BIGINT) AS place, '{{"row_count":' || (SELECT CAST(count(*) AS VARCHAR) || ',"total_amount":' || CAST(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS VARCHAR) FROM c) || ',"fiscal_years":' || {held}
        || ',"archived_csv_fiscal_years":' || {held} || ',"dashboard":{{"top_contractors":' || {contractors} || ',"top_entities":' || {entities} || ',"yearly_spending":' || {yearly} || '}},"recovery_targets":[' AS text
      UNION ALL SELECT 1, position, CASE WHEN position = min(position) OVER () THEN '' ELSE ',' END || '{{' || {fields} || '}}'
        FROM (SELECT *, CASE WHEN position % 2 = 0 THEN '2024-01-05' END AS last_checked_at FROM t WHERE status <> 'pending')
      UNION ALL SELECT 2, 0, ']}}'"""


def manifest(c, years: tuple[str, ...] = ()):
    """The manifest document of the register, in pieces. Contracts, families and targets are read several times, so each
    is made once and kept."""
    c = written(c.select("id", "contract_number", "entity", "contractor", "family", "amendment", "amount", "award_date", "valid_from", "valid_to", "fiscal_year"), "contracts")
    t = recovery.targets(recovery.family_scan(c)).withColumn("last_checked_at", F.when(F.col("position") % 2 == 0, "2024-01-05"))
    return loading.manifest_parts(c, written(families.board(c), "board"), written(recovery.publishable(t), "targets"), years)


YEARS = ("1996-1997", "1994-1995")
register("manifest", manifest_sql(), BOARD, TARGETS)(manifest)
register("manifest_of_archived_years", manifest_sql(YEARS), BOARD, TARGETS)(lambda c: manifest(c, YEARS))
AMONG = f"rep_fiscal_year IN ({', '.join(map(repr, YEARS))})"
register("top_contractors_archived", f"SELECT family, max(rep_contractor) AS contractor, count(*) AS families, {MONEY.format('total', 'money')} FROM b WHERE family <> '' AND {AMONG} GROUP BY family ORDER BY money DESC, families DESC, family LIMIT 5", BOARD)(
    lambda c: dashboard.top_contractors(families.board(c), years=YEARS)
)
register("top_entities_archived", f"SELECT entity, count(*) AS families, {MONEY.format('total', 'money')} FROM b WHERE {AMONG} GROUP BY entity ORDER BY money DESC, families DESC, entity LIMIT 5", BOARD)(
    lambda c: dashboard.top_entities(families.board(c), years=YEARS)
)
register("yearly_spending_archived", f"SELECT rep_fiscal_year AS fiscal_year, count(*) AS families, {MONEY.format('total', 'money')} FROM b WHERE {AMONG} GROUP BY rep_fiscal_year", BOARD)(
    lambda c: dashboard.by_year(families.board(c), YEARS)
)


def folder_for(c, name: str) -> str:
    return f"{checkpoint_dir(c.sparkSession)}/{name}-{uuid.uuid4().hex}"


def kept_families(c, name_counts: bool = True):
    """The roll-up after three loads, the last of them run twice."""
    path = folder_for(c, "families")
    c = written(c.select(*dict.fromkeys([*families.KEYS, *families.REP, "amendment"])), "contracts")
    release(c.sparkSession)  # the shuffle files behind it
    for load in (0, 1, 2, 2):
        rollup_store.refresh(c.where(F.col("id") % 3 == load), path, load, name_counts, 16)
    return rollup_store.families(c.sparkSession, path)


register("stored_rollup", "SELECT * FROM f", FAMILIES)(kept_families)
register("stored_families_page", f"{SUMMARY_SQL} ORDER BY award_date DESC NULLS LAST, id LIMIT 50 OFFSET 50", FAMILIES)(lambda c: search.page(families.summaries(kept_families(c)), "award_date", "DESC", 2))


def kept_records(c):
    """The records of a store after three loads with common records; its last load is run twice."""
    spark, path, state = c.sparkSession, folder_for(c, "store"), folder_for(c, "state")
    c = written(c, "contracts")
    release(spark)  # the shuffle files behind it
    rows = by_hash(c).withColumns({"source_rank": F.lit(0), "file": F.lit("a"), "pos": F.col("id")})
    for key, part in (("a", rows.where("id % 3 < 2")), ("b", rows.where("id % 2 = 0")), ("c", rows), ("c", rows)):
        store.load(part, path, state, key)
    return store.stored(spark, path), store.loads(spark, state)


LOADS = """h3 AS (SELECT row_hash, min(CASE WHEN id % 3 < 2 THEN 1 WHEN id % 2 = 0 THEN 2 ELSE 3 END) AS first FROM h GROUP BY row_hash)"""
register("stored_records", "SELECT row_hash, chr(96 + CAST(first AS INT)) AS load FROM h3", DOUBLE, LOADS)(lambda c: kept_records(c)[0].select("row_hash", "load"))
register(
    "stored_loads",
    """SELECT key, number, seen, added, seen - added AS known FROM (SELECT chr(CAST(96 + n AS INT)) AS key, CAST(n AS BIGINT) AS number, (SELECT count(*) FROM h WHERE CASE n WHEN 1 THEN id % 3 < 2 WHEN 2 THEN id % 2 = 0 ELSE true END) AS seen,
      (SELECT count(*) FROM h3 WHERE first = n) AS added FROM range(1, 4) r(n))""",
    DOUBLE, LOADS,
)(lambda c: kept_records(c)[1].select("key", "number", "seen", "added", "known"))


def rewritten_table(c):
    """A table by year in which three years hold dates in another style, after two rewrites."""
    path = folder_for(c, "table")
    old = F.col("fiscal_year").isin("1994-1995", "1995-1996", "1996-1997") & (F.col("id") % 3 == 0)
    day = lambda d: F.when(old, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    rows = c.select("id", "fiscal_year", "amendment", *(day(d).alias(d) for d in ("award_date", "valid_from", "valid_to"))).withColumn("amendment", F.nullif("amendment", F.lit("")))
    rows.repartition("fiscal_year").withColumn("written", F.lit(0)).write.partitionBy("fiscal_year").parquet(path)
    first = store.rewrite_changed(c.sparkSession, path)
    second = store.rewrite_changed(c.sparkSession, path)
    return c.sparkSession.read.parquet(path).withColumn("touched", F.col("fiscal_year").isin(first)).withColumn("again", F.lit(len(second)))


register(
    "rewritten_partitions",
    """SELECT id, CAST(fiscal_year AS VARCHAR) AS fiscal_year, CAST(award_date AS VARCHAR) AS award_date, CAST(valid_to AS VARCHAR) AS valid_to, nullif(amendment, '') AS amendment, fiscal_year IN ('1994-1995', '1995-1996', '1996-1997') AS touched, 0 AS again FROM c""",
)(lambda c: rewritten_table(c).select("id", "fiscal_year", "award_date", "valid_to", "amendment", "touched", "again"))
