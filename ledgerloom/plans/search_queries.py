"""Queries of the search screen: combined filters, pages, merged families, details and shown values."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import parse, shown, text
from ledgerloom.operators import families, keyword_index, recovery, search
from ledgerloom.plans.base import FAMILIES, MONEY, ORACLE_SQL, ORIGINAL, QUERIES, RANK, TARGETS, register
from ledgerloom.session import checkpoint_dir, table, written
from ledgerloom.sources.live import page_fields

ROW = ["id", "contract_number", "entity", "contractor", "amount", "award_date"]
COLUMNS = ", ".join(ROW)
WORDS = "upper(concat_ws(' ', contract_number, entity, contractor, service_category, service_type))"
PLACES = ("contract_number", "entity", "contractor", "service_category", "service_type")


def begins(word: str) -> str:
    return f"regexp_matches({WORDS}, '(^|[^0-9A-Z]){word}')"


def inside(word: str) -> str:
    return "(" + " OR ".join(f"contains(upper(coalesce({c}, '')), '{word}')" for c in PLACES) + ")"


def keyword(word: str) -> str:
    """The whole table decides whether parts of words count."""
    return f"CASE WHEN EXISTS (SELECT 1 FROM c WHERE {begins(word)}) THEN {begins(word)} ELSE {inside(word)} END"


def value(column: str, term: str) -> str:
    """The smallest equal value of the whole table, else all that begin with the term."""
    found = f"(SELECT min({column}) FROM c WHERE upper(trim({column})) = '{term}')"
    return f"CASE WHEN {found} IS NOT NULL THEN {column} = {found} ELSE starts_with(upper(trim({column})), '{term}') END"


def number(source: str, term: str) -> str:
    """Equal numbers among the rows that pass the other filters, else those that begin with the term."""
    return f"SELECT * FROM {source} WHERE CASE WHEN EXISTS (SELECT 1 FROM {source} WHERE upper(contract_number) = '{term}') THEN upper(contract_number) = '{term}' ELSE starts_with(upper(contract_number), '{term}') END"


def filters(name: str, given: dict, where: str, number_term: str = "") -> None:
    """Register a combination of filters beside its SQL."""
    base = f"p AS (SELECT * FROM c WHERE {where})"
    last = f"q AS ({number('p', number_term)})" if number_term else "q AS (SELECT * FROM p)"
    register(name, f"SELECT {COLUMNS} FROM q", base, last)(lambda c: search.filtered(c, given).select(*ROW))


filters(
    "filters_entity_amount_keyword",
    {"entity": "nation_1", "amount_min": 20000, "keyword": "inc", "award_from": "1995-01-01"},
    f"{value('entity', 'NATION_1')} AND amount >= 20000 AND {keyword('INC')} AND award_date >= DATE '1995-01-01'",
)
filters(
    "filters_fallback_with_year",
    {"keyword": "ustomer", "fiscal_year": "1995-1996", "amount_max": 40000, "contractor": "customer*corp."},
    f"{keyword('USTOMER')} AND fiscal_year = '1995-1996' AND amount <= 40000 AND contractor ILIKE 'customer%corp.'",
)
filters(
    "filters_service_type_prefix",
    {"service_type": "red ", "category": "PROMO", "valid_from": "1994-01-01", "valid_to": "1997-12-31"},
    f"{value('service_type', 'RED')} AND service_category = 'PROMO' AND valid_from >= DATE '1994-01-01' AND valid_to <= DATE '1997-12-31'",
)
filters("filters_service_type_value", {"service_type": "Red Widget ", "amount_min": 1000}, f"{value('service_type', 'RED WIDGET')} AND amount >= 1000")
filters("filters_number_exact", {"contract_number": "1997-000003", "amount_min": 10}, "amount >= 10", "1997-000003")
filters("filters_number_prefix", {"contract_number": "1997-0000", "entity": "nation", "amount_min": 5000}, f"{value('entity', 'NATION')} AND amount >= 5000", "1997-0000")



def kept(c, *more: str):
    """The id, texts and ``more`` columns of contracts as a table, which an index and its queries read several times."""
    return written(c.select("id", *search.TEXT_COLUMNS, *more), "contracts")


def indexed(c, name: str) -> str:
    """The folder of a new index of contracts, made by three loads, the last two merged into the first."""
    path = f"{checkpoint_dir(c.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for load in range(3):
        keyword_index.add(c.where(F.col("id") % 3 == load), path)
    keyword_index.compact(c.sparkSession, path)
    return path


def through_index(name: str, given: dict, where: str) -> None:
    """Register a combination of filters that looks its keyword up in an index."""
    register(name, f"SELECT {COLUMNS} FROM c WHERE {where}")(lambda c: (lambda k: search.filtered(k, given, index=indexed(k, name)).select(*ROW))(kept(c, "amount", "award_date", "fiscal_year")))


through_index("indexed_keyword", {"keyword": "custom inc", "amount_min": 20000}, f"amount >= 20000 AND {begins('CUSTOM')} AND {begins('INC')}")
through_index("indexed_keyword_fallback", {"keyword": "ustomer", "fiscal_year": "1995-1996"}, f"fiscal_year = '1995-1996' AND {inside('USTOMER')}")
register("keyword_postings", f"SELECT DISTINCT word, id FROM (SELECT id, unnest(string_split_regex({WORDS}, '[^0-9A-Z]+')) AS word FROM c) WHERE word <> ''")(lambda c: c.sparkSession.read.parquet(indexed(kept(c), "postings")).select("word", "id"))
ACCENTED = "a AS (SELECT * REPLACE ('Educación ' || lower(entity) AS entity) FROM c)"
FOLDED = "upper(strip_accents(concat_ws(' ', contract_number, entity, contractor, service_category, service_type)))"
accented = lambda c: c.withColumn("entity", F.concat(F.lit("Educación "), F.lower("entity")))
register("keyword_accents", f"SELECT id, entity FROM a WHERE regexp_matches({FOLDED}, '(^|[^0-9A-Z])EDUCACI') AND regexp_matches({FOLDED}, '(^|[^0-9A-Z])NATION') AND regexp_matches({FOLDED}, '(^|[^0-9A-Z])1') AND amount >= 20000", ACCENTED)(
    lambda c: search.filtered(accented(c), {"keyword": "educací nation_1", "amount_min": 20000}).select("id", "entity")
)
register("keyword_accents_fallback", "SELECT id, entity FROM a WHERE contains(upper(strip_accents(entity)), 'DUCACION') AND amount >= 20000", ACCENTED)(
    lambda c: search.filtered(accented(c), {"keyword": "ducación", "amount_min": 20000}).select("id", "entity")
)

SUMMARY_SQL = """SELECT contract_number, entity, family, rep_id AS id, rep_contractor AS contractor, rep_fiscal_year AS fiscal_year, rep_service_type AS service_type, rep_service_category AS service_category,
  rep_valid_from AS valid_from, rep_valid_to AS valid_to, rep_procurement_method AS procurement_method, rep_fund_type AS fund_type, family_size, total AS family_total_amount, has_original AS family_has_original,
  CASE WHEN has_original = 1 THEN rep_amount ELSE total END AS amount, CASE WHEN has_original = 1 THEN rep_award_date ELSE earliest END AS award_date FROM f"""


def filtered_families(where: str) -> str:
    """The family roll-up of the rows that pass."""
    return FAMILIES.replace("FROM c)", f"FROM c WHERE {where})")


register("families_page", f"{SUMMARY_SQL} ORDER BY award_date DESC NULLS LAST, id LIMIT 50 OFFSET 50", FAMILIES)(
    lambda c: search.page(families.summaries(families.rollup(c)), "award_date", "DESC", 2)
)
register("families_page_by_category", f"SELECT * FROM ({SUMMARY_SQL}) ORDER BY service_category NULLS LAST, id LIMIT 50", filtered_families("amount >= 30000 AND fiscal_year = '1995-1996'"))(
    lambda c: search.page(families.summaries(families.rollup(search.filtered(c, {"amount_min": 30000, "fiscal_year": "1995-1996"}))), "service_category", "ASC")
)
register("rows_header", f"SELECT count(*) AS n_rows, coalesce({MONEY.format('amount', 'x').removesuffix(' AS x')}, 0) AS money FROM c WHERE starts_with(contract_number, '1996-')")(
    lambda c: search.rows_header(search.filtered(c, {"contract_number": "1996-"}))
)
MERGED = f"""mo AS (SELECT *, {ORIGINAL} AS orig, row_number() OVER (PARTITION BY contract_number, entity, family ORDER BY CASE WHEN {ORIGINAL} THEN 0 ELSE 1 END, award_date NULLS FIRST, trim(amendment), id) AS rn FROM c WHERE starts_with(contract_number, '1996-')),
mg AS (SELECT contract_number, entity, family, count(*) AS family_size, {MONEY.format('amount', 'family_total_amount')}, CAST(max(CAST(orig AS INT)) AS INT) AS family_has_original, min(award_date) AS earliest,
  max(CASE WHEN rn = 1 THEN amount END) AS rep_amount, max(CASE WHEN rn = 1 THEN award_date END) AS rep_date, """ + ", ".join(f"max(CASE WHEN rn = 1 THEN {x} END) AS {x}" for x in ("id", "contractor", "service_category", "service_type", "fiscal_year", "valid_from", "valid_to", "procurement_method", "fund_type")) + " FROM mo GROUP BY contract_number, entity, family)"
MERGED_SQL = """SELECT id, contract_number, contractor, entity, family, service_category, service_type, fiscal_year, valid_from, valid_to, procurement_method, fund_type, family_size, family_total_amount, family_has_original,
  CASE WHEN family_has_original = 1 THEN coalesce(rep_amount, 0) ELSE family_total_amount END AS amount, CASE WHEN family_has_original = 1 THEN coalesce(rep_date, earliest) ELSE earliest END AS award_date FROM mg"""
register("merged_families", MERGED_SQL, MERGED)(lambda c: families.merged(search.filtered(c, {"contract_number": "1996-"})))
register("merged_page", f"SELECT * FROM ({MERGED_SQL}) ORDER BY lower(strip_accents(contractor)) DESC NULLS LAST, id LIMIT 50 OFFSET 50", MERGED)(
    lambda c: search.merged_page(families.merged(search.filtered(c, {"contract_number": "1996-"})), "contractor", "DESC", 2)
)
register("merged_page_by_amount", f"SELECT * FROM ({MERGED_SQL}) ORDER BY amount, id LIMIT 50", MERGED)(
    lambda c: search.merged_page(families.merged(search.filtered(c, {"contract_number": "1996-"})), "amount", "ASC")
)


def turned(rows, order: search.Order, number: int):
    """A page reached from the first by the last row of each page before it."""
    last = None
    for _ in range(number - 1):
        row = search.page_after(rows, order, last).orderBy(*(c for c in order.columns())).collect()[-1]
        last = (row[order.sort], row[order.tie])
    return search.page_after(rows, order, last)


by_type = search.Order("service_type", True, "id", True)
register("rows_page_by_position", f"SELECT {COLUMNS} FROM c ORDER BY service_type DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100")(lambda c: search.page_at(c, search.page_starts(c, by_type), 3, by_type).select(*ROW))
register("rows_page_after", f"SELECT {COLUMNS} FROM c ORDER BY service_type DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100")(lambda c: turned(c, by_type, 3).select(*ROW))
register("families_page_by_position", f"{SUMMARY_SQL} ORDER BY award_date DESC NULLS LAST, id LIMIT 50 OFFSET 200", FAMILIES)(
    lambda c: (lambda f, o: search.page_at(f, search.page_starts(f, o), 5, o))(families.summaries(families.rollup(c)), search.Order("award_date"))
)
register("page_starts", "SELECT CAST((place - 1) // 50 + 1 AS BIGINT) AS page, award_date AS value, id AS tie FROM (SELECT award_date, id, row_number() OVER (ORDER BY award_date NULLS LAST, id) AS place FROM c) WHERE place % 50 = 1")(
    lambda c: search.page_starts(c, search.Order("award_date", False))
)
ASKED = "k AS (SELECT DISTINCT contract_number, entity, family FROM c WHERE fiscal_year = '1994-1995')"
register(
    "family_look_up",
    f"""SELECT id, CAST(row_number() OVER (PARTITION BY contract_number, entity, family ORDER BY CASE WHEN {ORIGINAL} THEN 0 ELSE 1 END, award_date NULLS FIRST, amendment, id) AS INT) AS place
      FROM c SEMI JOIN k USING (contract_number, entity, family)""",
    ASKED,
)(lambda c: families.members_of(c, c.where("fiscal_year = '1994-1995'")).select("id", "place"))
register(
    "details_with_recovery",
    "SELECT c.id, t.status AS recovery_status, t.notes AS recovery_notes, t.lookup_mode AS recovery_lookup_mode FROM c LEFT JOIN t ON upper(trim(c.contract_number)) = t.contract_number AND upper(trim(c.entity)) = t.entity AND c.family = t.family",
    TARGETS,
)(lambda c: families.with_recovery(c, recovery.targets(recovery.family_scan(c))).select("id", "recovery_status", "recovery_notes", "recovery_lookup_mode"))
register(
    "distinct_service_types",
    "SELECT DISTINCT service_type AS value FROM c WHERE trim(service_type) <> ''",
)(lambda c: search.distinct_values(c, "service_type"))

MILLIONS = "amount * 37.0"
register(
    "shown_values",
    f"""SELECT id, '$' || format('{{:,.2f}}', amount) AS money_text,
      CASE WHEN {MILLIONS} < 999.95 THEN '$' || regexp_replace(format('{{:,.1f}}', round({MILLIONS}, 1)), '\\.0$', '') WHEN {MILLIONS} < 999950 THEN '$' || regexp_replace(format('{{:,.1f}}', round({MILLIONS} / 1000, 1)), '\\.0$', '') || 'K'
        ELSE '$' || regexp_replace(format('{{:,.1f}}', round({MILLIONS} / 1000000, 1)), '\\.0$', '') || 'M' END AS compact,
      strftime(award_date, '%B %-d, %Y') AS day_text, CASE WHEN length(service_type) > 12 THEN substr(service_type, 1, 12) || '...' ELSE service_type END AS short,
      format('{{:,}}', id) AS id_text, 'CSV preservado' AS source_label, 'https://r.example/contract/details?contractid=' || CAST(id AS VARCHAR) AS url, CAST(id AS VARCHAR) AS id_of_url,
      'https://r.example/contract/downloaddocument?code=' || replace(url_encode(amendment || ' x'), '%20', '+') AS document,
      concat_ws('; ', nullif(amendment, ''), contract_number) AS note FROM c""",
)(lambda c: c.select(
    "id", shown.money_text(F.col("amount")).alias("money_text"), shown.compact_money(F.col("amount") * 37.0).alias("compact"),
    shown.long_date(F.date_format("award_date", "MM/dd/yyyy")).alias("day_text"), shown.truncated(F.col("service_type"), 12).alias("short"),
    shown.thousands(F.col("id")).alias("id_text"), shown.label(F.col("source_type"), shown.SOURCE_LABELS["es"]).alias("source_label"),
    shown.detail_url("https://r.example", F.col("id")).alias("url"), shown.contract_id_of(shown.detail_url("https://r.example", F.col("id"))).alias("id_of_url"),
    shown.document_url("https://r.example", F.concat("amendment", F.lit(" x"))).alias("document"), shown.note(F.col("amendment"), F.col("contract_number")).alias("note"),
))
register(
    "keys_and_codes",
    r"""SELECT id, trim(replace(replace(replace(upper(regexp_replace(contractor || ' (P.R.)', '[\x00.,;:()/\-]', ' ', 'g')), '  ', ' '), '  ', ' '), '  ', ' ')) AS coarse,
      entity_number AS code, entity AS name, contractor || ' & ' || chr(233) || '<' AS decoded, CAST(year(award_date - INTERVAL '6' MONTH) AS INT) AS year_start,
      CAST(left(fiscal_year, 4) AS INT) AS key_start, upper(entity) AS entity_key FROM c""",
)(lambda c: c.select(
    "id", text.coarse_family(F.concat("contractor", F.lit(" (P.R.)"))).alias("coarse"),
    text.split_entity(F.concat_ws(" | ", "entity_number", "entity"))["code"].alias("code"), text.split_entity(F.concat_ws(" | ", "entity_number", "entity"))["name"].alias("name"),
    shown.unescaped(F.concat("contractor", F.lit(" &amp; &#233;&lt;"))).alias("decoded"), parse.fiscal_year_start(parse.fiscal_year(F.col("award_date"))).alias("year_start"),
    parse.fiscal_year_key(F.col("fiscal_year"))["start"].alias("key_start"), text.fold_entity(F.concat_ws(" | ", "entity_number", "entity")).alias("entity_key"),
))
register("years_in_order", "SELECT fiscal_year, row_number() OVER (ORDER BY fiscal_year DESC) AS place FROM (SELECT DISTINCT fiscal_year FROM c)")(
    lambda c: c.select("fiscal_year").distinct().withColumn("place", F.row_number().over(years_down()))
)


def years_down():
    """Newest year first; for the few years of a table."""
    from pyspark.sql import Window

    return Window.orderBy(parse.fiscal_year_key(F.col("fiscal_year")).desc())


def family_function(spark, sf_dir: str):
    """Customers by contractor family, through the SQL function that the session offers."""
    text.register_functions(spark)
    return spark.sql("SELECT c_custkey, normalize_contractor_family(concat('Ing. ', c_name, ' y Asociados, L.L.C.')) AS family FROM {customers}", customers=table(spark, sf_dir, "customer"))


QUERIES["family_function"] = family_function
ORACLE_SQL["family_function"] = f"SELECT c_custkey, {text.family_sql(chr(39) + 'Ing. ' + chr(39) + ' || c_name || ' + chr(39) + ' y Asociados, L.L.C.' + chr(39))} AS family FROM customer"
QUERIES["page_fields"] = lambda spark, sf_dir: page_fields(table(spark, sf_dir, "pages"))
ORACLE_SQL["page_fields"] = r"""
WITH p AS (SELECT page_id, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)
SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title,
  nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), '') AS heading,
  CAST(len(regexp_extract_all(html, '(?i)<a ')) AS INT) AS links FROM p"""
