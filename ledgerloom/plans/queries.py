"""Register queries over the given tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.parse import money
from ledgerloom.operators import dashboard, families, loading, recovery, search
from ledgerloom.plans.base import BOARD, DOUBLE, FAMILIES, HASH, MONEY, ORACLE_SQL, ORIGINAL, QUERIES, SCAN, TARGETS, by_hash, loaded_twice, register
from ledgerloom.sources.contracts import canonical, raw_text

R = register
ROW = "id, contract_number, entity, contractor, amount, award_date"
cols = [c.strip() for c in ROW.split(",")]
R("top_contractors", f"SELECT family, max(rep_contractor) AS contractor, count(*) AS families, {MONEY.format('total', 'money')} FROM b WHERE family <> '' GROUP BY family ORDER BY money DESC, families DESC, family LIMIT 5", BOARD)(lambda c: dashboard.top_contractors(families.board(c)))
R("top_entities", f"SELECT entity, count(*) AS families, {MONEY.format('total', 'money')} FROM b GROUP BY entity ORDER BY money DESC, families DESC, entity LIMIT 5", BOARD)(lambda c: dashboard.top_entities(families.board(c)))
R("yearly_spending", f"SELECT rep_fiscal_year AS fiscal_year, count(*) AS families, {MONEY.format('total', 'money')} FROM b GROUP BY rep_fiscal_year", BOARD)(lambda c: dashboard.by_year(families.board(c)))
R("share_of_largest_year", f"SELECT *, money / max(money) OVER () AS share FROM (SELECT rep_fiscal_year AS fiscal_year, count(*) AS families, {MONEY.format('total', 'money')} FROM b GROUP BY rep_fiscal_year)", BOARD)(lambda c: dashboard.share_of_largest(dashboard.by_year(families.board(c))))
R("table_stats", f"SELECT count(*) AS n_rows, {MONEY.format('amount', 'money')}, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM c")(dashboard.table_stats)
R("rows_by_entity", f"SELECT entity, count(*) AS n_rows, {MONEY.format('amount', 'money')} FROM c GROUP BY entity ORDER BY n_rows DESC, entity LIMIT 10")(lambda c: dashboard.rows_by(c, "entity").orderBy(F.desc("n_rows"), "entity").limit(10))
R("rows_by_year", f"SELECT fiscal_year, count(*) AS n_rows, {MONEY.format('amount', 'money')} FROM c GROUP BY fiscal_year")(lambda c: dashboard.rows_by(c, "fiscal_year"))
R("family_rollup", "SELECT * FROM f", FAMILIES)(families.rollup)
R("family_rollup_dashboard", "SELECT * FROM b", BOARD)(lambda c: families.rollup(c, False))
R("family_shown", "SELECT contract_number, entity, family, CASE WHEN has_original = 1 THEN rep_amount ELSE total END AS amount, CASE WHEN has_original = 1 THEN rep_award_date ELSE earliest END AS award_date FROM f", FAMILIES)(lambda c: families.shown(families.rollup(c)).select(*families.KEYS, "amount", "award_date"))
R("family_representatives", f"SELECT {ROW} FROM fr WHERE rn = 1", FAMILIES)(lambda c: families.representatives(c).select(*cols))
R("family_members", f"SELECT id, family, CAST(row_number() OVER (PARTITION BY contract_number, entity, family ORDER BY CASE WHEN {ORIGINAL} THEN 0 ELSE 1 END, award_date NULLS FIRST, amendment, id) AS INT) AS place FROM c")(lambda c: families.members(c).select("id", "family", "place"))
R(
    "amendment_counts",
    f"""SELECT id, CAST(count(*) FILTER (WHERE NOT {ORIGINAL}) OVER (PARTITION BY contract_number, entity, family) + CASE WHEN {ORIGINAL} THEN 1 ELSE 0 END AS BIGINT) AS amendments FROM c""",
)(families.amendment_counts)
R(
    "amendments_list",
    f"""SELECT s.id AS shown_id, m.id, m.amendment, m.amount, m.award_date, m.valid_from, m.valid_to, m.service_type, CAST(m.place AS INT) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY contract_number, entity, family ORDER BY CASE WHEN {ORIGINAL} THEN 0 ELSE 1 END, award_date NULLS FIRST, amendment, id) AS place FROM c) m
      JOIN c s USING (contract_number, entity, family) WHERE s.award_date >= DATE '1998-06-01' AND m.id <> s.id""",
)(lambda c: families.amendments_of(c, c.where("award_date >= '1998-06-01'")))
R(
    "family_links",
    """SELECT contract_number, entity, family, CASE WHEN family_size > 1 OR has_original = 0
      THEN 'contract.html?contract_number=' || url_encode(contract_number) || '&entity=' || replace(url_encode(entity), '%20', '+') || '&contractor=' || replace(url_encode(rep_contractor), '%20', '+')
      ELSE 'contract.html?id=' || CAST(rep_id AS VARCHAR) END || '&back=page%3D2' AS link FROM f""",
    FAMILIES,
)(lambda c: families.links(families.rollup(c), "#page=2"))
R("result_header", f"SELECT count(*) AS families, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages, {MONEY.format('total', 'money')} FROM f", FAMILIES)(lambda c: families.rollup(c).agg(F.count("*").alias("families"), F.ceil(F.count("*") / 50).alias("pages"), money(F.col("total")).alias("money")))
R("keyword_prefix", f"SELECT {ROW} FROM c WHERE regexp_matches(upper(concat_ws(' ', contract_number, entity, contractor, service_category, service_type)), '(^|[^0-9A-Z])CUSTOMER') AND regexp_matches(upper(concat_ws(' ', contract_number, entity, contractor, service_category, service_type)), '(^|[^0-9A-Z])INC')")(lambda c: c.where(search.keyword_prefix("customer inc")).select(*cols))
R("keyword_part", f"SELECT {ROW} FROM c WHERE " + "(" + " OR ".join(f"contains(upper({x}), '00001')" for x in ("contract_number", "entity", "contractor", "service_category", "service_type")) + ")")(lambda c: c.where(search.keyword_part("00001")).select(*cols))
KEYWORD_HIT = "regexp_matches(upper(concat_ws(' ', contract_number, entity, contractor, service_category, service_type)), '(^|[^0-9A-Z]){0}')"
ANY_COLUMN = "(" + " OR ".join("contains(upper(coalesce(" + x + ", '')), '{0}')" for x in ("contract_number", "entity", "contractor", "service_category", "service_type")) + ")"
R(
    "keyword_fallback",
    f"""SELECT {ROW} FROM c WHERE CASE WHEN EXISTS (SELECT 1 FROM c WHERE {KEYWORD_HIT.format('USTOMER')}) THEN {KEYWORD_HIT.format('USTOMER')} ELSE {ANY_COLUMN.format('USTOMER')} END""",
)(lambda c: search.keyword(c, "ustomer").select(*cols))
R(
    "keyword_no_fallback",
    f"""SELECT {ROW} FROM c WHERE CASE WHEN EXISTS (SELECT 1 FROM c WHERE {KEYWORD_HIT.format('INC')}) THEN {KEYWORD_HIT.format('INC')} ELSE {ANY_COLUMN.format('INC')} END""",
)(lambda c: search.keyword(c, "inc").select(*cols))
R("contractor_starts", f"SELECT {ROW} FROM c WHERE contractor ILIKE 'customer%' OR contractor ILIKE '% customer%'")(lambda c: c.where(search.contractor_matches("customer")).select(*cols))
R("contractor_pattern", f"SELECT {ROW} FROM c WHERE contractor ILIKE 'customer%1%inc.'")(lambda c: c.where(search.contractor_matches("customer*1*inc.")).select(*cols))
R("entity_exact_or_prefix", f"SELECT {ROW} FROM c WHERE CASE WHEN EXISTS (SELECT 1 FROM c WHERE upper(trim(entity)) = 'NATION_1') THEN upper(trim(entity)) = 'NATION_1' ELSE starts_with(upper(trim(entity)), 'NATION_1') END")(lambda c: search.exact_or_prefix(c, "entity", "nation_1").select(*cols))
R("entity_prefix", f"SELECT {ROW} FROM c WHERE starts_with(upper(entity), 'NATION_')")(lambda c: search.exact_or_prefix(c, "entity", "nation_").select(*cols))
R("contract_number_prefix", f"SELECT {ROW} FROM c WHERE starts_with(contract_number, '1996-0')")(lambda c: search.number_matches(c, "1996-0").select(*cols))
R("amount_and_dates", f"SELECT {ROW} FROM c WHERE amount BETWEEN 20000 AND 60000 AND award_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND valid_from >= DATE '1995-03-01' AND valid_to <= DATE '1997-12-01'")(lambda c: search.filtered(c, {"amount_min": 20000, "amount_max": 60000, "award_from": "1995-01-01", "award_to": "1997-12-31", "valid_from": "1995-03-01", "valid_to": "1997-12-01"}).select(*cols))
R("category_and_year", f"SELECT {ROW} FROM c WHERE fiscal_year = '1996-1997' AND service_category = (SELECT min(service_category) FROM c)")(lambda c: c.where("fiscal_year = '1996-1997'").join(F.broadcast(c.agg(F.min("service_category").alias("service_category"))), "service_category").select(*cols))
R("search_page", "SELECT contract_number, entity, family, family_size, CASE WHEN has_original = 1 THEN rep_amount ELSE total END AS amount FROM f ORDER BY amount DESC NULLS LAST, rep_id LIMIT 50", FAMILIES)(lambda c: search.page(families.shown(families.rollup(c)), "amount", ties=("rep_id",)).select(*families.KEYS, "family_size", "amount"))
R("search_page_filtered", "SELECT contract_number, entity, family, total FROM (SELECT contract_number, entity, family, " + MONEY.format("amount", "total") + ", min(award_date) AS earliest, min(id) AS id FROM c WHERE amount >= 30000 AND fiscal_year = '1995-1996' GROUP BY contract_number, entity, family) ORDER BY earliest, id LIMIT 50 OFFSET 50")(lambda c: search.page(families.rollup(search.filtered(c, {"amount_min": 30000, "fiscal_year": "1995-1996"})).join(search.filtered(c, {"amount_min": 30000, "fiscal_year": "1995-1996"}).groupBy(*families.KEYS).agg(F.min("id").alias("id")), families.KEYS).withColumn("award_date", F.col("earliest")), "award_date", "ASC", 2).select(*families.KEYS, "total"))
R("rows_page", f"SELECT {ROW} FROM c ORDER BY award_date NULLS LAST, id LIMIT 50 OFFSET 50")(lambda c: search.rows_page(c, "award_date", "ASC", 2).select(*cols))
R("rows_page_descending", f"SELECT {ROW} FROM c ORDER BY service_type DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100")(lambda c: search.rows_page(c, "service_type", "DESC", 3).select(*cols))
R("distinct_categories", "SELECT DISTINCT service_category AS value FROM c WHERE trim(service_category) <> ''")(lambda c: search.distinct_values(c, "service_category"))
R("canonical_records", f"SELECT contract_number, entity, contractor, amendment, amount, CAST(NULL AS DOUBLE) AS amount_receivable, award_date, valid_to, cancelled, fiscal_year, row_hash FROM (SELECT * REPLACE (award_date AS valid_to), {HASH} AS row_hash FROM c)")(lambda c: canonical(raw_text(c)).select("contract_number", "entity", "contractor", "amendment", "amount", "amount_receivable", "award_date", "valid_to", "cancelled", "fiscal_year", "row_hash"))
R("first_wins", "SELECT row_hash, file, id FROM w WHERE rn = 1", DOUBLE)(lambda c: loading.first_wins(loaded_twice(c)).select("row_hash", "file", "id"))
R(
    "unseen_records",
    "SELECT id, row_hash FROM h WHERE row_hash NOT IN (SELECT row_hash FROM h WHERE fiscal_year <= '1995-1996')",
    DOUBLE,
)(lambda c: loading.unseen(by_hash(c), by_hash(c).where("fiscal_year <= '1995-1996'")).select("id", "row_hash"))
R("load_log", "SELECT file, count(*) AS parsed, CAST(count(*) FILTER (WHERE rn = 1) AS BIGINT) AS new_rows, CAST(count(*) FILTER (WHERE rn > 1) AS BIGINT) AS duplicates FROM w GROUP BY file", DOUBLE)(lambda c: loading.load_log(loaded_twice(c)))
R("year_gaps", "SELECT CAST(y AS VARCHAR) || '-' || CAST(y + 1 AS VARCHAR) AS fiscal_year FROM range(1985, 2011) r(y) WHERE CAST(y AS VARCHAR) || '-' || CAST(y + 1 AS VARCHAR) NOT IN (SELECT fiscal_year FROM c)")(lambda c: loading.year_gaps(c, 1985, 2010))
R(
    "aligned_source_type",
    """SELECT id, contract_number, CAST(0 AS INT) AS cancelled, CASE WHEN id % 2 = 0 THEN 'csv' ELSE 'live_monitor' END AS source_type, CAST(NULL AS VARCHAR) AS pco_number FROM c""",
)(lambda c: loading.aligned(
    c.select("id", "contract_number", F.when(F.col("id") % 2 == 0, " ").otherwise("live_monitor").alias("source_type")),
    c.limit(0).select("id", "contract_number", "cancelled", "source_type", F.lit(None).cast("string").alias("pco_number")),
))
R(
    "published_snapshot",
    """SELECT id, contract_number, entity, entity_number, contractor, nullif(trim(amendment), '') AS amendment, service_category, service_type, amount, amount_receivable,
      award_date, valid_from, valid_to, procurement_method, fund_type, CAST(NULL AS VARCHAR) AS pco_number, cancelled, CAST(NULL AS VARCHAR) AS document_url, fiscal_year, source_type,
      CAST(NULL AS VARCHAR) AS source_url, CAST(NULL AS VARCHAR) AS source_contract_id FROM c""",
)(loading.snapshot)
R("recent_records", f"SELECT {ROW} FROM c WHERE award_date >= (SELECT max(award_date) FROM c) - INTERVAL '7' DAY")(lambda c: c.join(F.broadcast(c.agg(F.date_sub(F.max("award_date"), 7).alias("since"))), F.col("award_date") >= F.col("since")).select(*cols))
R("export_rows", "SELECT id, contract_number, entity, contractor, CASE WHEN amendment = '' THEN 'ORIGINAL' ELSE amendment END AS amendment, '$' || format('{:,.2f}', amount) AS amount_text, strftime(award_date, '%B %-d, %Y') AS award_text, CASE WHEN length(service_type) > 12 THEN substr(service_type, 1, 12) || '...' ELSE service_type END AS service FROM c ORDER BY award_date DESC, id")(lambda c: c.orderBy(F.desc("award_date"), "id").select("id", "contract_number", "entity", "contractor", F.when(F.col("amendment") == "", "ORIGINAL").otherwise(F.col("amendment")).alias("amendment"), F.concat(F.lit("$"), F.format_number("amount", 2)).alias("amount_text"), F.date_format("award_date", "MMMM d, yyyy").alias("award_text"), F.when(F.length("service_type") > 12, F.concat(F.substring("service_type", 1, 12), F.lit("..."))).otherwise(F.col("service_type")).alias("service")))
R("family_scan", "SELECT * FROM s", SCAN)(recovery.family_scan)
R("missing_originals", "SELECT * FROM m", TARGETS)(lambda c: recovery.missing_originals(recovery.family_scan(c)))
R("recovery_targets", "SELECT * FROM t", TARGETS)(lambda c: recovery.targets(recovery.family_scan(c)))
R("publishable_targets", "SELECT * FROM t WHERE status IS DISTINCT FROM 'pending'", TARGETS)(lambda c: recovery.publishable(recovery.targets(recovery.family_scan(c))))
R(
    "target_violations",
    """SELECT * FROM (SELECT *, CASE WHEN lookup_mode NOT IN ('manual_url', 'auto_discover') THEN 'unknown lookup mode'
      WHEN status NOT IN ('pending', 'recovered', 'unrecoverable', 'ambiguous') THEN 'unknown status' WHEN trim(coalesce(recovery_batch, '')) = '' THEN 'no batch' END AS reason
      FROM (SELECT * REPLACE (CASE WHEN position % 5 = 0 THEN 'odd' ELSE status END AS status, CASE WHEN position % 7 = 0 THEN ' ' ELSE recovery_batch END AS recovery_batch) FROM t)) WHERE reason IS NOT NULL""",
    TARGETS,
)(lambda c: recovery.violations(recovery.targets(recovery.family_scan(c)).withColumns({
    "status": F.when(F.col("position") % 5 == 0, "odd").otherwise(F.col("status")),
    "recovery_batch": F.when(F.col("position") % 7 == 0, " ").otherwise(F.col("recovery_batch")),
})))
R("targets_to_process", "SELECT * FROM t WHERE status = 'pending' AND recovery_batch = '1995-1996'", TARGETS)(lambda c: recovery.selected(recovery.targets(recovery.family_scan(c)), batches=("1995-1996",)))
R("pending_by_batch", "SELECT coalesce(recovery_batch, '(missing)') AS batch, count(*) AS pending FROM t WHERE status = 'pending' GROUP BY 1", TARGETS)(lambda c: recovery.pending_by_batch(recovery.targets(recovery.family_scan(c))))
R("targets_by_status", "SELECT status, count(*) AS targets FROM t GROUP BY status", TARGETS)(lambda c: recovery.by_status(recovery.targets(recovery.family_scan(c))))
R("row_recovery_status", "SELECT c.id, arg_min(t.status, t.position) AS recovery_status FROM c LEFT JOIN t ON upper(c.contract_number) = t.contract_number AND upper(c.entity) = t.entity AND c.family = t.family GROUP BY c.id", TARGETS)(lambda c: recovery.with_targets(c, recovery.targets(recovery.family_scan(c))))
R(
    "placeholder_originals",
    """SELECT f.contract_number, coalesce(t.entity, f.entity) AS entity, f.family, coalesce(t.contractor, f.rep_contractor) AS contractor, '' AS amendment,
      CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS DATE) AS award_date, CAST(NULL AS VARCHAR) AS fiscal_year, 0 AS cancelled, t.source_url,
      CASE WHEN t.status <> 'recovered' THEN t.status END AS recovery_status, CASE WHEN t.status <> 'recovered' THEN t.notes END AS recovery_notes,
      CASE WHEN t.status <> 'recovered' THEN t.lookup_mode END AS recovery_lookup_mode, 1 AS is_placeholder_original
      FROM f LEFT JOIN t ON t.contract_number = upper(f.contract_number) AND t.entity = upper(f.entity) AND t.family = f.family WHERE has_original = 0""",
    FAMILIES, TARGETS,
)(lambda c: families.placeholders(families.rollup(c), recovery.targets(recovery.family_scan(c))))
