"""Contract families: an original and its amendments, by number, entity and contractor family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.parse import money
from ledgerloom.functions.text import amendment_text, contractor_family, is_original
from ledgerloom.session import dealt

KEYS = ["contract_number", "entity", "family"]
#: What a family shows of its representative row.
REP = ("id", "amount", "award_date", "contractor", "fiscal_year", "service_type", "cancelled", "service_category", "valid_from", "valid_to", "procurement_method", "fund_type")


def member_order(name_counts: bool = True) -> Column:
    """Originals first, then by date (none first) and id."""
    return F.struct(F.when(is_original(F.col("amendment"), name_counts), 0).otherwise(1).alias("amended"), F.coalesce("award_date", F.lit("0001-01-01").cast("date")).alias("d"), F.col("id"))


def rollup(rows: DataFrame, name_counts: bool = True, shows: tuple[str, ...] = REP) -> DataFrame:
    """One row for each family, by one aggregation: size, total, earliest date, and what it ``shows`` of its
    representative row (fewer columns make a smaller aggregation)."""
    rep = F.min_by(F.struct(*shows), member_order(name_counts))
    got = dealt(rows, *KEYS).groupBy(*KEYS).agg(F.count("*").alias("family_size"), money(F.col("amount")).alias("total"), F.max(is_original(F.col("amendment"), name_counts).cast("int")).alias("has_original"), F.min("award_date").alias("earliest"), rep.alias("rep"))
    return got.select(*KEYS, "family_size", "total", "has_original", "earliest", *(F.col(f"rep.{c}").alias(f"rep_{c}") for c in shows))


def board(rows: DataFrame) -> DataFrame:
    """The roll-up as dashboards need it: an original is a blank amendment, and two columns are shown."""
    return rollup(rows, False, ("contractor", "fiscal_year"))


def shown(families: DataFrame) -> DataFrame:
    """Amount and date to show: the original's, else the family's total and earliest date."""
    has = F.col("has_original") == 1
    return families.withColumns({"amount": F.when(has, F.col("rep_amount")).otherwise(F.col("total")), "award_date": F.when(has, F.col("rep_award_date")).otherwise(F.col("earliest"))})


def summaries(families: DataFrame) -> DataFrame:
    """Families as a result page shows them: the representative's columns, size and total, amount and date to show."""
    named = {c: F.col(f"rep_{c}") for c in ("id", "contractor", "fiscal_year", "service_type", "service_category", "valid_from", "valid_to", "procurement_method", "fund_type")}
    return shown(families).select("contract_number", "entity", "family", *(v.alias(k) for k, v in named.items()), "family_size", F.col("total").alias("family_total_amount"), F.col("has_original").alias("family_has_original"), "amount", "award_date")


def text_order(c: Column) -> Column:
    """Text as people sort it, and not by code points."""
    return F.collate(c, "UNICODE")


def merged(rows: DataFrame) -> DataFrame:
    """Families as a contract-number search merges them: null keys are blank, the amendment's text breaks ties before
    the id, a null amount shows 0 and a missing date the earliest of the family."""
    order = F.struct(F.when(is_original(F.col("amendment")), 0).otherwise(1).alias("amended"), F.coalesce("award_date", F.lit("0001-01-01").cast("date")).alias("d"), text_order(amendment_text(F.col("amendment"))).alias("t"), F.col("id"))
    blank = [F.coalesce(c, F.lit("")).alias(f"__{c}") for c in KEYS]
    got = rows.groupBy(*blank).agg(
        F.count("*").alias("family_size"), F.coalesce(money(F.col("amount")), F.lit(0.0)).alias("family_total_amount"),
        F.max(is_original(F.col("amendment")).cast("int")).alias("family_has_original"), F.min("award_date").alias("earliest"),
        F.min_by(F.struct("contract_number", "entity", *REP), order).alias("rep"),
    )
    has = F.col("family_has_original") == 1
    return got.select(
        "rep.id", "rep.contract_number", "rep.contractor", "rep.entity", F.col("__family").alias("family"),
        *(F.col(f"rep.{c}").alias(c) for c in ("service_category", "service_type", "fiscal_year", "valid_from", "valid_to", "procurement_method", "fund_type")),
        "family_size", "family_total_amount", "family_has_original",
        F.when(has, F.coalesce("rep.amount", F.lit(0.0))).otherwise(F.col("family_total_amount")).alias("amount"),
        F.when(has, F.coalesce("rep.award_date", "earliest")).otherwise(F.col("earliest")).alias("award_date"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """The first member of each family, by one aggregation."""
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), member_order()).alias("row")
    return dealt(rows, *KEYS).groupBy(*(F.col(k).alias(f"__{k}") for k in KEYS)).agg(row).select("row.*")


def members(rows: DataFrame) -> DataFrame:
    """All rows with their place in the family: originals, date, amendment, id."""
    w = Window.partitionBy(*KEYS).orderBy(F.when(is_original(F.col("amendment")), 0).otherwise(1), F.asc_nulls_first("award_date"), text_order(amendment_text(F.col("amendment"))), "id")
    return dealt(rows, *KEYS).withColumn("place", F.row_number().over(w))


def members_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The members of the families that ``asked`` names (contract_number, entity, contractor), with their places; an
    asked family is found by the family of its contractor's name."""
    keys = asked.where("contract_number <> '' and entity <> '' and contractor <> ''").select("contract_number", "entity", contractor_family(F.col("contractor")).alias("family")).distinct()
    return members(rows.join(keys, KEYS, "left_semi"))


def amendments_of(rows: DataFrame, shown_ids: DataFrame) -> DataFrame:
    """The other members of each shown row's family, in order: (shown_id, place, id and what the list shows)."""
    one = shown_ids.select(F.col("id").alias("shown_id")).join(rows, F.col("shown_id") == F.col("id")).select("shown_id", *KEYS)
    got = members(rows).join(one, KEYS).where("id <> shown_id")
    return got.select("shown_id", "place", "id", "amendment", "amount", "award_date", "valid_from", "valid_to", "service_type")


def amendment_counts(rows: DataFrame) -> DataFrame:
    """For each row the number of rows that amend its family, and the row itself if it does not; null keys are equal."""
    original = is_original(F.col("amendment"))
    amended = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in KEYS)).agg(F.count_if(~original).alias("amended"))
    return rows.join(amended, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]).select("id", (F.col("amended") + original.cast("int")).alias("amendments"))


def placeholders(families: DataFrame, targets: DataFrame) -> DataFrame:
    """A header row for each family of amendments only. Its entity and contractor are the recovery target's where one
    is known; the state of the recovery is shown unless it is done."""
    rows = families.where("has_original = 0").withColumnRenamed("rep_contractor", "contractor")
    got = first_target(rows, targets, [*KEYS, "contractor"])
    state = F.lower(F.trim(F.coalesce("target.status", F.lit(""))))
    open_ = (state != "") & (state != "recovered")
    none = {c: F.lit(None).cast(t) for c, t in {"id": "long", "amount": "double", "award_date": "date", "fiscal_year": "string"}.items()}
    return got.select(
        "contract_number", F.coalesce(F.nullif("target.entity", F.lit("")), "entity").alias("entity"), "family", F.coalesce(F.nullif("target.contractor", F.lit("")), "contractor").alias("contractor"),
        F.lit("").alias("amendment"), *(v.alias(k) for k, v in none.items()), F.lit(0).alias("cancelled"), F.col("target.source_url").alias("source_url"),
        F.when(open_, F.col("target.status")).alias("recovery_status"), F.when(open_, F.col("target.notes")).alias("recovery_notes"), F.when(open_, F.col("target.lookup_mode")).alias("recovery_lookup_mode"),
        F.lit(1).alias("is_placeholder_original"),
    )


def first_target(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The columns ``keys`` of distinct rows with the first ``target`` by position of their number and entity (upper
    case, accents count) whose family is theirs, or any for a blank family; null where there is none."""
    key = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    t = targets.withColumn("__family", contractor_family(F.col("contractor")))
    t = t.select(key("contract_number").alias("__number"), key("entity").alias("__entity"), "__family", F.col("position").alias("__position"), F.struct("entity", "contractor", "source_url", "status", "notes", "lookup_mode").alias("target"))
    t = t.where("__number <> '' and __entity <> ''")
    by_family = t.groupBy("__number", "__entity", "__family").agg(F.min_by("target", "__position").alias("target"))
    any_family = t.groupBy("__number", "__entity").agg(F.min_by("target", "__position").alias("any_target"))
    rows = rows.select(*keys).distinct().withColumns({"__n": key("contract_number"), "__e": key("entity")})
    on = (F.col("__n") == F.col("__number")) & (F.col("__e") == F.col("__entity"))
    got = rows.join(by_family, on & (F.col("family") == F.col("__family")), "left").drop("__number", "__entity", "__family").join(any_family, on, "left")
    return got.select(*keys, F.when(F.col("family") == "", F.col("any_target")).otherwise(F.col("target")).alias("target"))


def with_recovery(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Contract rows with the state, notes and mode of their recovery target. A placeholder (``is_placeholder_original``)
    whose target is recovered shows none of them."""
    found = first_target(rows, targets, KEYS).select(*(F.col(k).alias(f"__{k}") for k in KEYS), "target")
    got = rows.join(found, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS], "left")
    shows = F.lower(F.trim(F.coalesce("target.status", F.lit("")))) != "recovered"
    if "is_placeholder_original" in rows.columns:
        shows = shows | (F.coalesce("is_placeholder_original", F.lit(0)) == 0)
    else:
        shows = F.lit(True)
    pick = lambda c, t: F.coalesce(F.col(c), F.when(shows, F.col(f"target.{t}"))) if c in rows.columns else F.when(shows, F.col(f"target.{t}"))
    have = [c for c in rows.columns if not c.startswith("recovery_")]
    return got.select(*have, pick("recovery_status", "status").alias("recovery_status"), pick("recovery_notes", "notes").alias("recovery_notes"), pick("recovery_lookup_mode", "lookup_mode").alias("recovery_lookup_mode"))


def links(families: DataFrame, back: str = "") -> DataFrame:
    """Where a family leads: to the family, by number, entity and contractor, if it has several rows or no original,
    else to its row."""
    whole = (F.col("family_size") > 1) | (F.col("has_original") == 0)
    part = lambda name, c: [F.lit(name), F.url_encode(F.coalesce(F.col(c), F.lit("")))]
    family = F.concat(*part("contract.html?contract_number=", "contract_number"), *part("&entity=", "entity"), *part("&contractor=", "rep_contractor"))
    one = F.concat(F.lit("contract.html?id="), F.col("rep_id").cast("string"))
    end = F.concat(F.lit("&back="), F.url_encode(F.lit(back.lstrip("#")))) if back.lstrip("#") else F.lit("")
    return families.select(*KEYS, F.concat(F.when(whole, family).otherwise(one), end).alias("link"))
