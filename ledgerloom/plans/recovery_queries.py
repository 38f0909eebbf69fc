"""Queries of the recovery of missing originals: targets, search results, detail pages, conflicts and outcomes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import parse, shown
from ledgerloom.operators import loading, recovery, resolution
from ledgerloom.plans.base import HASH as WHOLE_HASH
from ledgerloom.plans.base import ORIGINAL, TARGETS, by_hash, register
from ledgerloom.session import release, written
from ledgerloom.sources import live
from ledgerloom.sources.contracts import RECORD, TARGET

BASE = "https://register.example"
HASH = WHOLE_HASH.replace("CAST(award_date AS VARCHAR)", "coalesce(CAST(award_date AS VARCHAR), '')")


def targets_of(c: DataFrame) -> DataFrame:
    return recovery.targets(recovery.family_scan(c))


def search_of(t: DataFrame, least: int = 0) -> DataFrame:
    """Search rows of targets: none, one or two (``least`` at least) for each; a second one of even targets is an
    amendment, every fifth names another firm."""
    j, p = F.col("j"), F.col("position")
    rows = t.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(p % 3, F.lit(least)).cast("int")))).where(j < F.greatest(p % 3, F.lit(least)))
    day = F.unix_date(F.date_add(F.lit("1999-01-01").cast("date"), (p % 900).cast("int"))).cast("long")
    stamp = lambda more: F.concat(F.lit("/Date("), ((day + more) * 86_400_000 + 43_200_000).cast("string"), F.lit(")/"))
    name = F.when(p % 5 == 0, F.lit("Another Firm &amp; Sons")).otherwise(F.col("contractor"))
    return rows.select(
        (p % 25).cast("int").alias("EntityId"), F.concat_ws(" | ", (p % 25).cast("string"), "entity").alias("EntityName"), (p * 10 + j).alias("ContractId"),
        F.col("contract_number").alias("ContractNumber"), F.when((j == 1) & (p % 2 == 0), "A").alias("Amendment"), stamp(0).alias("DateOfGrant"),
        stamp(0).alias("EffectiveDateFrom"), stamp(30).alias("EffectiveDateTo"), F.lit("ADVICE").alias("Service"), F.lit("SERVICES").alias("ServiceGroup"),
        F.when(p % 4 == 3, stamp(0)).alias("CancellationDate"), (p % 1000 + 0.5).cast("double").alias("AmountToPay"), F.lit(0.0).alias("AmountToReceive"), F.lit(True).alias("HasAmendments"),
        F.when(p % 2 == 1, F.concat(F.lit("doc"), p.cast("string"))).alias("DocumentWithoutSocialSecurityId"), F.array(F.struct(F.lit(None).cast("string").alias("Name")), F.struct(name.alias("Name"))).alias("Contractors"),
    )


def pages_of(rows: DataFrame) -> DataFrame:
    """A detail page of each search row, written as the register writes them. Some have another number or no date."""
    day = parse.epoch_date(F.col("DateOfGrant"))
    months = F.array(*(F.lit(m) for m in ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")))
    spanish = lambda d: F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.get(months, F.month(d) - 1), F.lit(". "), F.year(d).cast("string"))
    field = lambda k, v: F.concat(F.lit(f'<input id="{k}" value="'), F.coalesce(v, F.lit("")), F.lit('" />\n'))
    n = F.col("ContractId")
    html = F.concat(
        F.lit('<html><body><div class="card">\n'), field("EntityName", F.col("EntityName")), field("ContractNumber", F.when(n % 11 == 0, "0000-000000").otherwise(F.col("ContractNumber"))),
        field("Amendment", F.col("Amendment")), field("DateOfGrant", F.when(n % 13 != 0, spanish(day))), field("EffectiveDateFrom", spanish(day)), field("EffectiveDateTo", spanish(F.date_add(day, 30))),
        field("Amount", F.concat(F.lit("$"), F.format_number("AmountToPay", 2))), field("AmountToReceive", F.lit("$0.00")), F.lit('<span id="ServiceGroup"> <b>SERVICES</b> &amp; more</span>'),
        field("ContractingForm", F.lit("No Aplica")), field("Fund", F.lit("")),
        F.lit("<h5>Contratista</h5>\n<table><tbody>\n<tr><td>"), F.col("Contractors")[1]["Name"], F.lit("</td></tr>\n</tbody></table></div></body></html>"),
    )
    return rows.select(shown.detail_url(BASE, n).alias("url"), html.alias("html"), F.col("ContractId"))


def search_sql(name: str, least: int = 0) -> str:
    """The same search rows, already typed, as SQL."""
    return f"""{name} AS (SELECT position, j, contract_number, entity, CAST(position % 25 AS VARCHAR) AS entity_number,
  CASE WHEN position % 5 = 0 THEN 'Another Firm & Sons' ELSE contractor END AS contractor, contractor AS target_contractor, family, lookup_mode, position % 5 = 0 AS other,
  CASE WHEN j = 1 AND position % 2 = 0 THEN 'A' ELSE '' END AS amendment, position % 1000 + CAST(0.5 AS DOUBLE) AS amount,
  CAST(DATE '1999-01-01' + CAST(position % 900 AS INTEGER) AS DATE) AS award_date, position * 10 + j AS contract_id, position % 4 = 3 AS cancelled, position % 2 = 1 AS has_document
  FROM (SELECT *, unnest(range(greatest(position % 3, {least}))) AS j FROM t))"""


YEAR = "CAST(year(award_date - INTERVAL '6' MONTH) AS VARCHAR) || '-' || CAST(year(award_date - INTERVAL '6' MONTH) + 1 AS VARCHAR)"
RECORD_SQL = f"""contract_number, entity, entity_number, contractor, amendment, 'SERVICES' AS service_category, 'ADVICE' AS service_type, amount, CAST(0 AS DOUBLE) AS amount_receivable, award_date,
  award_date AS valid_from, CAST(award_date + 30 AS DATE) AS valid_to, CAST(NULL AS VARCHAR) AS procurement_method, CAST(NULL AS VARCHAR) AS fund_type, CAST(NULL AS VARCHAR) AS pco_number,
  CAST(cancelled AS INT) AS cancelled, CASE WHEN has_document THEN '{BASE}/contract/downloaddocument?code=doc' || CAST(position AS VARCHAR) END AS document_url,
  {YEAR} AS fiscal_year, 'live_monitor' AS source_type, '{BASE}/contract/details?contractid=' || CAST(contract_id AS VARCHAR) AS source_url, CAST(contract_id AS VARCHAR) AS source_contract_id"""
register("search_records", f"SELECT {RECORD_SQL}, {HASH} AS row_hash FROM r", TARGETS, search_sql("r"))(
    lambda c: live.search_records(search_of(targets_of(c)), BASE, "live_monitor")
)
register("search_candidates", "SELECT position, contract_id FROM r WHERE amendment = '' AND NOT other", TARGETS, search_sql("r"))(
    lambda c: resolution.candidates(targets_of(c), search_of(targets_of(c))).select("position", F.col("search.ContractId").alias("contract_id"))
)
DETAIL_SQL = f"""d AS (SELECT position, j, contract_id, family, target_contractor, other, lookup_mode, entity AS target_entity, contract_number AS target_number,
  CASE WHEN contract_id % 11 = 0 THEN '0000-000000' ELSE contract_number END AS contract_number, entity, entity_number, contractor, amendment, 'SERVICES & more' AS service_category, amount,
  CASE WHEN contract_id % 13 <> 0 THEN award_date END AS award_date, award_date AS valid_from, CAST(award_date + 30 AS DATE) AS valid_to, 'No Aplica' AS procurement_method,
  '{BASE}/contract/details?contractid=' || CAST(contract_id AS VARCHAR) AS source_url, CAST(contract_id AS VARCHAR) AS source_contract_id, cancelled, has_document FROM r)"""
register(
    "detail_records",
    f"""SELECT contract_number, entity, entity_number, contractor, amendment, service_category, amount, award_date, valid_to, procurement_method, {YEAR} AS fiscal_year, source_url, source_contract_id,
      entity_number || ' | ' || entity AS entity_display, contractor AS first_name, {HASH} AS row_hash FROM d""",
    TARGETS, search_sql("r", 1), DETAIL_SQL,
)(lambda c: live.detail_records(pages_of(search_of(targets_of(c), 1))).select(
    "contract_number", "entity", "entity_number", "contractor", "amendment", "service_category", "amount", "award_date", "valid_to", "procurement_method", "fiscal_year",
    "source_url", "source_contract_id", "entity_display", F.get("contractor_names", F.lit(0)).alias("first_name"), "row_hash",
))


class Case(NamedTuple):
    """What a recovery works on."""

    targets: DataFrame
    rows: DataFrame
    pages: DataFrame
    entities: DataFrame
    known: DataFrame
    recovered: DataFrame


TWICE, RIVAL = 1 << 40, 1 << 41
NO_TEXT = ("pco_number", "document_url", "source_url", "source_contract_id")


def case_of(c: DataFrame) -> Case:
    """All targets with a valid mode; some a second time, some again for another contractor, which a search row of its own
    names. Some pages cannot be had, some targets with a URL lack it, and some originals were recovered before. Entities
    whose name ends in 7 have two codes."""
    c, p = written(c, "contracts"), F.col("position")
    own = F.when((F.col("lookup_mode") == "manual_url") & (p % 5 != 3), shown.detail_url(BASE, p * 10))
    t = targets_of(c).where(F.col("lookup_mode").isin(*recovery.MODES)).withColumn("source_url", own)
    t = written(t, "targets")
    rivals = t.where(p % 6 == 2).withColumn("contractor", F.lit("Rival Works"))
    again = t.where(p % 6 == 0).withColumn("position", p + TWICE).unionByName(rivals.withColumn("position", p + RIVAL))
    name = F.array(F.struct(F.lit(None).cast("string").alias("Name")), F.struct(F.lit("Rival Works").alias("Name")))
    more = search_of(rivals, 1).where("ContractId % 10 = 0").withColumns({"ContractId": F.col("ContractId") + 5, "Contractors": name})
    names = c.select(F.col("entity").alias("name"), F.col("entity_number").alias("code")).distinct().checkpoint()  # a row for each entity
    none = {x: F.lit(None).cast("string") for x in NO_TEXT}
    before = t.where(p % 9 == 4).select(
        *(F.col(x) if x in ("contract_number", "entity", "contractor") else F.lit(v).cast(k).alias(x) for x, k, v in BEFORE), F.col("position").alias("pos"),
    )
    return Case(
        t.unionByName(again), search_of(t).unionByName(more), pages_of(search_of(t, 1).unionByName(more)).where("ContractId % 17 <> 0"),
        names.unionByName(names.where("name LIKE '%7'").withColumn("code", F.lit("x"))), by_hash(c.withColumns(none)), by_hash(before),
    )


#: The columns of the originals that were recovered before, with their kinds and values.
BEFORE = [(x, "double" if x.startswith("amount") else "date" if x in ("award_date", "valid_from", "valid_to") else "int" if x == "cancelled" else "string", {"amendment": "", "amount": 1.0, "award_date": "2001-01-01", "cancelled": 0, "source_type": "live_recovery"}.get(x)) for x in RECORD]


def checked_of(c: DataFrame) -> DataFrame:
    case = case_of(c)
    _, asked = resolution.asked_pages(case.targets, case.rows, case.entities, BASE)
    return resolution.checked_pages(case.targets, asked, case.pages, BASE).withColumn("detail_id", shown.contract_id_of(F.col("url")).cast("long"))


def recovered_of(c: DataFrame) -> resolution.Recovery:
    return resolution.recover(*case_of(c), BASE)


CASE = f"""q AS (SELECT *, position AS base, false AS rival, lookup_mode = 'manual_url' AND position % 5 = 3 AS no_url FROM t WHERE lookup_mode IN ('manual_url', 'auto_discover')),
qq AS (SELECT * FROM q UNION ALL SELECT * REPLACE (position + {TWICE} AS position) FROM q WHERE position % 6 = 0
  UNION ALL SELECT * REPLACE (position + {RIVAL} AS position, 'Rival Works' AS contractor, 'RIVAL WORKS' AS family, true AS rival) FROM q WHERE position % 6 = 2),
dd AS (SELECT *, false AS rival FROM d WHERE lookup_mode IN ('manual_url', 'auto_discover') UNION ALL
  SELECT * REPLACE (contract_id + 5 AS contract_id, CASE WHEN (contract_id + 5) % 11 = 0 THEN '0000-000000' ELSE target_number END AS contract_number, CASE WHEN (contract_id + 5) % 13 <> 0 THEN valid_from END AS award_date,
    'Rival Works' AS contractor, 'RIVAL WORKS' AS family, false AS other, '{BASE}/contract/details?contractid=' || CAST(contract_id + 5 AS VARCHAR) AS source_url), true FROM d WHERE j = 0 AND position % 6 = 2 AND lookup_mode IN ('manual_url', 'auto_discover')),
k AS (SELECT qq.position, contract_id, qq.lookup_mode, dd.position AS base, amendment, dd.contract_number, target_number, dd.entity, dd.contractor, dd.family, other, award_date, valid_from, cancelled, has_document, service_category, dd.source_url, contract_id % 17 = 0 AS missing,
    qq.entity NOT LIKE '%7' AND amendment = '' AND NOT other AND (dd.rival OR j < dd.position % 3) AS searched
  FROM qq JOIN dd ON dd.target_number = qq.contract_number AND dd.target_entity = qq.entity AND dd.family = qq.family AND dd.rival = qq.rival
  WHERE CASE WHEN qq.lookup_mode = 'manual_url' THEN dd.position = qq.base AND j = 0 AND NOT no_url ELSE qq.entity NOT LIKE '%7' AND amendment = '' AND NOT other AND (dd.rival OR j < dd.position % 3) END)"""
REASON = f"""CASE WHEN missing THEN NULL WHEN amendment <> '' THEN '{resolution.NOT_ORIGINAL}' WHEN contract_number <> target_number THEN '{resolution.WRONG_NUMBER}'
  WHEN other THEN '{resolution.WRONG_CONTRACTOR}' WHEN award_date IS NULL THEN '{resolution.NO_DATE}' END"""
CHECKED = f"kk AS (SELECT *, {REASON} AS reason FROM k)"
CASE_PARTS = (TARGETS, search_sql("r", 1), DETAIL_SQL, CASE, CHECKED)
register("detail_checks", "SELECT position, contract_id AS detail_id, missing, reason FROM kk", *CASE_PARTS)(lambda c: checked_of(c).select("position", "detail_id", "missing", "reason"))
register(
    "enriched_records",
    f"""SELECT position, contract_id AS detail_id, contract_number, entity, contractor, service_category, CASE WHEN searched THEN 'ADVICE' END AS service_type,
      CASE WHEN searched THEN coalesce(award_date, valid_from) ELSE award_date END AS award_date, CASE WHEN searched THEN CAST(cancelled AS INT) ELSE 0 END AS cancelled,
      CASE WHEN searched AND has_document THEN '{BASE}/contract/downloaddocument?code=doc' || CAST(base AS VARCHAR) END AS document_url, source_url FROM kk WHERE NOT missing""",
    *CASE_PARTS,
)(lambda c: checked_of(c).where("not missing").select("position", "detail_id", "contract_number", "entity", "contractor", "service_category", "service_type", "award_date", "cancelled", "document_url", "source_url"))
OUTCOME = f"""g AS (SELECT position, count(*) AS n_all, count(*) FILTER (WHERE reason IS NULL AND NOT missing) AS n, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons, min(source_url) FILTER (WHERE missing) AS lost FROM kk GROUP BY position),
first_original AS (SELECT contract_number, entity, arg_min(family, id) AS family FROM c WHERE upper(trim(amendment)) IN ('', 'ORIGINAL') GROUP BY contract_number, entity),
before AS (SELECT contract_number, entity, arg_min(family, position) AS family FROM q WHERE base % 9 = 4 GROUP BY contract_number, entity),
x AS (SELECT qq.*, coalesce(g.n, 0) AS n, coalesce(g.n_all, 0) AS n_all, g.reasons, g.lost, coalesce(p.family, b.family) AS parent,
  CASE WHEN lookup_mode = 'manual_url' THEN NOT no_url ELSE coalesce(g.n_all, 0) > 0 END AS found FROM qq LEFT JOIN g ON g.position = qq.position
  LEFT JOIN first_original p ON p.contract_number = qq.contract_number AND p.entity = qq.entity LEFT JOIN before b ON b.contract_number = qq.contract_number AND b.entity = qq.entity),
y AS (SELECT *, found AND lost IS NULL AND n = 1 AND parent IS NULL AS free FROM x),
z AS (SELECT *, row_number() OVER w AS place, first_value(family) OVER w AS written FROM y WINDOW w AS (PARTITION BY contract_number, entity, free ORDER BY CAST(left(recovery_batch, 4) AS INT) DESC, recovery_batch, family, lookup_mode, position)),
o AS (SELECT *, CASE WHEN lookup_mode = 'manual_url' THEN '{resolution.MANUAL}' WHEN entity LIKE '%7' THEN '{resolution.NO_ENTITY}' ELSE 'search returned ' || CAST(n_all AS VARCHAR) || ' exact candidate(s)' END AS discovery,
  no_url OR lost IS NOT NULL AS kept, CASE WHEN NOT free THEN CASE WHEN parent <> family THEN '{resolution.OTHER_FAMILY}' ELSE '{resolution.OTHER_ROW}' END
    WHEN place = 1 THEN '{resolution.RECOVERED}' WHEN written = family THEN '{resolution.SAME_ROW}' ELSE '{resolution.OTHER_FAMILY}' END AS met FROM z)"""
register(
    "target_outcomes",
    f"""SELECT position, CASE WHEN kept THEN status WHEN NOT found OR n = 0 THEN 'unrecoverable' WHEN n > 1 THEN 'ambiguous' WHEN met IN ('{resolution.RECOVERED}', '{resolution.SAME_ROW}') THEN 'recovered' ELSE 'ambiguous' END AS status,
      CASE WHEN no_url THEN '{resolution.NO_URL}' WHEN lost IS NOT NULL THEN 'error: no page for ' || lost WHEN NOT found THEN discovery WHEN n = 0 THEN discovery || coalesce('; ' || reasons, '')
        WHEN n > 1 THEN discovery || '; ' || CAST(n AS VARCHAR) || ' validated candidates remain' ELSE discovery || '; ' || met END AS notes FROM o""",
    *CASE_PARTS, OUTCOME,
)(lambda c: recovered_of(c).outcomes.select("position", "status", "notes"))
register(
    "recovered_records",
    f"""SELECT o.position, kk.contract_number, kk.entity, kk.contractor, kk.award_date, kk.source_url FROM o JOIN kk ON kk.position = o.position AND reason IS NULL
      WHERE NOT kept AND found AND n = 1 AND met = '{resolution.RECOVERED}'""",
    *CASE_PARTS, OUTCOME,
)(lambda c: recovered_of(c).added.select("position", "contract_number", "entity", "contractor", "award_date", "source_url"))


def varied(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known rows, and records made from originals: the same, with another method, another sum receivable, another
    amount, or another number, by id."""
    none = {x: F.lit(None).cast("string") for x in ("pco_number", "document_url", "source_url", "source_contract_id")}
    known = by_hash(c.withColumns(none))
    k = F.col("id") % 5
    made = c.where("trim(amendment) = ''").withColumns(none | {
        "procurement_method": F.when(k == 1, "other").otherwise(F.col("procurement_method")), "amount_receivable": F.when(k == 2, 5.0).otherwise(F.col("amount_receivable")),
        "amount": F.when(k == 3, F.col("amount") + 1).otherwise(F.col("amount")), "contract_number": F.when(k == 4, F.concat(F.lit("X"), "contract_number")).otherwise(F.col("contract_number")),
    })
    return known, by_hash(made)


MATCH = """({0}.amount = z.amount AND {0}.award_date = z.award_date AND {0}.valid_from = z.valid_from AND {0}.valid_to = z.valid_to AND {0}.contract_number = z.contract_number AND {0}.entity = z.entity
  AND {0}.entity_number = z.entity_number AND {0}.amount_receivable = z.amount_receivable AND {0}.family = z.family)"""
SAME = "(" + MATCH.format("{0}") + """ AND {0}.contractor = z.contractor AND {0}.amendment = z.amendment AND {0}.service_category = z.service_category AND {0}.service_type = z.service_type
  AND {0}.procurement_method = z.procurement_method AND {0}.fund_type = z.fund_type AND {0}.cancelled = z.cancelled AND {0}.fiscal_year = z.fiscal_year AND {0}.source_type = z.source_type)"""
VARIED = f"""h AS (SELECT *, {HASH} AS row_hash FROM c),
z0 AS (SELECT * REPLACE (CASE WHEN id % 5 = 1 THEN 'other' ELSE procurement_method END AS procurement_method, CASE WHEN id % 5 = 2 THEN CAST(5 AS DOUBLE) ELSE amount_receivable END AS amount_receivable,
  CASE WHEN id % 5 = 3 THEN amount + 1 ELSE amount END AS amount, CASE WHEN id % 5 = 4 THEN 'X' || contract_number ELSE contract_number END AS contract_number) FROM c WHERE trim(amendment) = ''),
z AS (SELECT *, {HASH} AS row_hash FROM z0),
tw AS (SELECT row_hash, min(id) AS tid FROM h GROUP BY row_hash),
pr AS (SELECT contract_number, entity, min(id) AS pid FROM c WHERE upper(trim(amendment)) IN ('', 'ORIGINAL') GROUP BY contract_number, entity)"""
register(
    "recovery_conflicts",
    f"""SELECT z.id, CASE WHEN a.id IS NOT NULL AND {SAME.format('a')} THEN 'identical' WHEN a.id IS NOT NULL AND {MATCH.format('a')} THEN 'needs_enrichment' WHEN a.id IS NOT NULL THEN 'hash_conflict'
      WHEN b.id IS NOT NULL AND {SAME.format('b')} THEN 'identical' WHEN b.id IS NOT NULL AND {MATCH.format('b')} THEN 'needs_enrichment' WHEN b.id IS NOT NULL THEN 'family_conflict' ELSE 'ok' END AS conflict,
      b.id IS NOT NULL AND b.family <> z.family AND a.id IS NULL AND NOT {MATCH.format('b')} AS other_family
      FROM z LEFT JOIN tw ON tw.row_hash = z.row_hash LEFT JOIN c a ON a.id = tw.tid LEFT JOIN pr ON pr.contract_number = z.contract_number AND pr.entity = z.entity LEFT JOIN c b ON b.id = pr.pid""",
    VARIED,
)(lambda c: (lambda known, made: resolution.conflicts(made, known, known.limit(0).withColumn("pos", F.lit(0))).select("id", "conflict", (F.col("conflict_note") == resolution.OTHER_FAMILY).alias("other_family")))(*varied(c)))
register(
    "upserted_rows",
    """SELECT count(*) AS n, count(*) FILTER (WHERE fresh) AS added, CAST(sum(amount) AS DECIMAL(18,2))::DOUBLE AS money FROM (
      SELECT amount, false AS fresh FROM c WHERE id % 2 = 0 UNION ALL
      SELECT amount, true FROM (SELECT DISTINCT * EXCLUDE (id, family) FROM c WHERE id % 3 = 0) n WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.id % 2 = 0 AND
        """ + " AND ".join(f"o.{x} IS NOT DISTINCT FROM n.{x}" for x in ("contract_number", "entity", "entity_number", "contractor", "amendment", "service_category", "service_type", "amount", "amount_receivable", "award_date", "valid_from", "valid_to", "procurement_method", "fund_type", "cancelled", "fiscal_year", "source_type")) + "))",
)(lambda c: (lambda known: resolution.upserted(known.where("id % 2 = 0").withColumn("pos", F.col("id")), known.where("id % 3 = 0")).agg(F.count("*").alias("n"), F.count_if(F.col("pos").isNull()).alias("added"), parse.money(F.col("amount")).alias("money")))(varied(c)[0]))
UPSERT = ("contract_number", "entity", "contractor", "amendment", "award_date", "amount", "service_type")
register(
    "upserted_record_rows",
    f"""SELECT {', '.join(UPSERT)}, id AS pos FROM c WHERE id % 2 = 0 UNION ALL
      SELECT {', '.join(UPSERT)}, NULL FROM (SELECT DISTINCT * EXCLUDE (id, family) FROM c WHERE id % 3 = 0) n WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.id % 2 = 0 AND
        """ + " AND ".join(f"o.{x} IS NOT DISTINCT FROM n.{x}" for x in ("contract_number", "entity", "entity_number", "contractor", "amendment", "service_category", "service_type", "amount", "amount_receivable", "award_date", "valid_from", "valid_to", "procurement_method", "fund_type", "cancelled", "fiscal_year", "source_type")) + ")",
)(lambda c: (lambda known: resolution.upserted(known.where("id % 2 = 0").withColumn("pos", F.col("id")), known.where("id % 3 = 0")).select(*UPSERT, "pos"))(varied(c)[0]))


def scanned(c: DataFrame) -> DataFrame:
    """The family scan as a table, which targets, tracking files and seeding read several times. What Spark keeps on disk
    to make the contracts goes before they do."""
    scan = written(recovery.family_scan(c), "scan")
    release(c.sparkSession)
    return scan


def tracked(scan: DataFrame) -> DataFrame:
    """A tracking file: all targets, a second entry of every third one, and families that have an original."""
    t = recovery.targets(scan).withColumn("last_checked_at", F.when(F.col("position") % 2 == 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("position") % 28 + 1).cast("string"), 2, "0"))))
    t = t.where("position % 5 <> 1")  # the others are seeded again
    again = t.where("position % 3 = 0").withColumns({
        "status": F.lit("ambiguous"), "notes": F.lit("second entry"), "lookup_mode": F.lit("manual_url"), "source_url": F.lit(None).cast("string"),
        "last_checked_at": F.lit("2024-01-15"), "position": F.col("position") + (1 << 40),
    })
    done = scan.where("has_original = 1 and row_count > 2").select(
        F.col("number_key").alias("contract_number"), F.col("entity_key").alias("entity"), "contractor", F.lit(" ").alias("recovery_batch"), F.lit("auto_discover").alias("lookup_mode"), F.lit(None).cast("string").alias("source_url"),
        F.when(F.col("rep_id") % 2 == 0, "recovered").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("last_checked_at"), (F.col("rep_id") + (1 << 41)).alias("position"),
    )
    columns = [*TARGET, "position"]
    return t.select(*columns).unionByName(again.select(*columns)).unionByName(done.select(*columns))


MERGED = """e AS (SELECT contract_number, entity, contractor, family, recovery_batch, lookup_mode, source_url, status, notes,
  CASE WHEN position % 2 = 0 THEN '2024-01-' || lpad(CAST(position % 28 + 1 AS VARCHAR), 2, '0') END AS checked, position FROM t WHERE position % 5 <> 1),
w AS (SELECT *, CASE status WHEN 'pending' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'unrecoverable' THEN 2 ELSE 3 END AS rank, position % 3 = 0 AS twice FROM e),
f2 AS (SELECT *, twice AND NOT (rank > 1 OR (rank = 1 AND lookup_mode = 'manual_url' AND (source_url IS NOT NULL))) AS second FROM w),
keep AS (SELECT contract_number, entity, contractor, recovery_batch, CASE WHEN second THEN 'manual_url' ELSE lookup_mode END AS lookup_mode, source_url, CASE WHEN second THEN 'ambiguous' ELSE status END AS status,
  CASE WHEN second THEN 'second entry' WHEN twice THEN coalesce(notes, 'second entry') ELSE notes END AS notes, CASE WHEN twice THEN greatest(coalesce(checked, '2024-01-15'), '2024-01-15') ELSE checked END AS last_checked_at FROM f2
  UNION ALL SELECT number_key, entity_key, contractor, recovery_batch, 'auto_discover', NULL, 'recovered', NULL, NULL FROM s WHERE has_original = 1 AND row_count > 2 AND rep_id % 2 = 0
  UNION ALL SELECT contract_number, entity, contractor, recovery_batch, 'auto_discover', NULL, 'pending', NULL, NULL FROM t WHERE position % 5 = 1)"""
register("seeded_targets", "SELECT * FROM keep", TARGETS, MERGED)(lambda c: (lambda scan: recovery.seeded(tracked(scan), scan))(scanned(c)))
register(
    "seed_counts",
    """SELECT (SELECT count(*) FROM t WHERE position % 5 = 1) AS added, (SELECT count(*) FROM t) AS candidates, (SELECT count(*) FROM s WHERE has_original = 1 AND row_count > 2 AND rep_id % 2 = 1) AS removed,
      (SELECT count(*) FROM t WHERE position % 5 <> 1 AND position % 3 = 0) AS collapsed""",
    TARGETS,
)(lambda c: (lambda scan: recovery.seed_counts(tracked(scan), scan))(scanned(c)))
register(
    "targets_in_order",
    """SELECT position, row_number() OVER (ORDER BY CAST(left(recovery_batch, 4) AS INT) DESC, contract_number, entity, family, lookup_mode, position) AS place FROM t""",
    TARGETS,
)(lambda c: loading.load_ids(targets_of(c).withColumns({f"k{i}": k for i, k in enumerate(recovery.target_order())}), [*(f"k{i}" for i in range(6)), "position"]).select("position", F.col("id").alias("place")))


def spelled(c: DataFrame) -> DataFrame:
    """Contracts whose numbers and entities are written in several ways, with and without code, accents and capitals."""
    k = F.col("id")
    number = F.concat("contract_number", F.when(k % 2 == 0, "-a").otherwise("-A"))
    entity = F.when(k % 3 == 0, F.concat(F.lit("Educación "), F.lower("entity"))).when(k % 3 == 1, F.concat_ws(" | ", "entity_number", F.concat(F.lit("EDUCACIÓN "), "entity"))).otherwise(F.concat(F.lit("  educacion  "), "entity"))
    return c.withColumns({"contract_number": number, "entity": entity})


SPELLED = f"""e AS (SELECT * REPLACE (contract_number || CASE WHEN id % 2 = 0 THEN '-a' ELSE '-A' END AS contract_number,
    CASE id % 3 WHEN 0 THEN 'Educación ' || lower(entity) WHEN 1 THEN entity_number || ' | EDUCACIÓN ' || entity ELSE '  educacion  ' || entity END AS entity), upper(contract_number) || '-A' AS number_key, 'EDUCACION ' || entity AS entity_key FROM c),
es AS (SELECT number_key, entity_key, family, count(*) AS row_count, CAST(max(CAST({ORIGINAL} AS INT)) AS INT) AS has_original, arg_min(contract_number, row(award_date, id)) AS contract_number, trim(arg_min(entity, row(award_date, id))) AS entity,
  arg_min(contractor, row(award_date, id)) AS contractor, arg_min(fiscal_year, row(award_date, id)) AS recovery_batch, arg_min(id, row(award_date, id)) AS rep_id FROM e GROUP BY number_key, entity_key, family)"""
register("family_scan_spelled", "SELECT * FROM es", SPELLED)(lambda c: recovery.family_scan(spelled(c)))


def tracked_spelled(scan: DataFrame) -> DataFrame:
    """A tracking file with the folded spelling of two of three families without an original, and of some that have one."""
    rows = scan.where("(row_count > 1 and has_original = 0 and rep_id % 3 > 0) or (has_original = 1 and row_count > 3)")
    none = {x: F.lit(None).cast("string").alias(x) for x in ("source_url", "notes", "last_checked_at")}
    return rows.select(
        F.col("number_key").alias("contract_number"), F.concat(F.lit("9 |  "), F.lower("entity_key")).alias("entity"), "contractor", F.when(F.col("rep_id") % 2 == 0, F.col("recovery_batch")).alias("recovery_batch"), F.lit("auto_discover").alias("lookup_mode"), none["source_url"],
        F.when(F.col("rep_id") % 5 == 0, "recovered").otherwise("ambiguous").alias("status"), none["notes"], none["last_checked_at"], F.col("rep_id").alias("position"),
    )


register(
    "seeded_targets_spelled",
    """SELECT number_key AS contract_number, '9 |  ' || lower(entity_key) AS entity, contractor, recovery_batch, 'auto_discover' AS lookup_mode, CAST(NULL AS VARCHAR) AS source_url, CASE WHEN rep_id % 5 = 0 THEN 'recovered' ELSE 'ambiguous' END AS status,
      CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS VARCHAR) AS last_checked_at FROM es WHERE (row_count > 1 AND has_original = 0 AND rep_id % 3 > 0) OR (has_original = 1 AND row_count > 3 AND rep_id % 5 = 0)
      UNION ALL SELECT contract_number, entity, contractor, recovery_batch, 'auto_discover', NULL, 'pending', NULL, NULL FROM es WHERE row_count > 1 AND has_original = 0 AND rep_id % 3 = 0""",
    SPELLED,
)(lambda c: (lambda scan: recovery.seeded(tracked_spelled(scan), scan))(scanned(spelled(c))))
register("targets_of_number", "SELECT * FROM t WHERE status IN ('pending', 'ambiguous') AND lookup_mode IN ('manual_url', 'auto_discover') AND (lookup_mode <> 'manual_url' OR source_url IS NOT NULL) AND contract_number = (SELECT min(contract_number) FROM t WHERE status = 'pending')", TARGETS)(
    lambda c: (lambda t: recovery.selected(t, ("ambiguous",), all_pending=True).join(F.broadcast(t.where("status = 'pending'").agg(F.min("contract_number").alias("contract_number"))), "contract_number", "left_semi"))(written(targets_of(c), "targets"))
)
register("entity_codes", "SELECT entity_key, code FROM (SELECT upper(entity) AS entity_key, min(entity_number) AS code, count(DISTINCT entity_number) AS n FROM c GROUP BY 1) WHERE n = 1")(
    lambda c: resolution.entity_codes(c.select(F.col("entity").alias("name"), F.col("entity_number").alias("code")).distinct())
)
