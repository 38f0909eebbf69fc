"""Resolution of recovery targets: search candidates, checks of detail pages, conflicts with known rows, outcomes.

One set-based job: targets meet search rows on number and folded entity, candidates meet their detail pages on the
URL, and what is left meets the known rows on hash and on (number, entity). No table is gathered anywhere. Targets are
worked on in their order, and a later one sees what earlier ones recovered: a row is written only where its number and
entity have no original yet, so of the targets of one number and entity the first that could be written is the only
one, and all later ones meet its record. That takes one aggregation, and no loop over targets.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import shown
from ledgerloom.functions.parse import row_hash
from ledgerloom.functions.text import contractor_family, fold_entity, is_original, strip
from ledgerloom.operators.recovery import target_rank
from ledgerloom.session import checkpoint_dir
from ledgerloom.sources.contracts import RECORD
from ledgerloom.sources.live import contractor_names, detail_records, search_records

# The notes of outcomes.
NOT_ORIGINAL = "detail page is not the original contract row"
WRONG_NUMBER = "detail page contract number does not match the recovery target"
WRONG_ENTITY = "detail page entity does not match the recovery target"
WRONG_CONTRACTOR = "detail page contractor family does not match the recovery target"
NO_DATE = "detail page is missing an award date"
SAME_ROW, SAME_ORIGINAL = "matching recovered row already exists", "matching original row already exists for this family"
DEFER = "existing original already present; defer live detail supplementation to enrichment track"
COLLISION = "row hash collision with a different existing row"
OTHER_FAMILY = "existing original row in this family has a conflicting contractor family"
OTHER_ROW = "existing original row in this family conflicts with the recovered row"
RECOVERED, READY, NO_ENTITY, MANUAL = "recovered original row", "ready to write", "entity lookup returned no exact match", "validated manual detail URL"
NO_URL = "manual_url target is missing source_url"


def family_among(target: Column, names: Column) -> Column:
    """Whether a contractor's family is among those of the names; a blank one always is."""
    family = contractor_family(target)
    return (family == "") | F.array_contains(F.transform(names, contractor_family), family)


def entity_codes(entities: DataFrame) -> DataFrame:
    """(entity_key, code) of the entities (name, code) whose folded name has exactly one entry."""
    return entities.groupBy(fold_entity(F.col("name")).alias("entity_key")).agg(F.count("*").alias("n"), F.first("code").alias("code")).where("n = 1").select("entity_key", "code")


def candidates(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """(position, search) of each target's search rows: of its number and entity, originals, and with a contractor of
    its family where contractors are named."""
    row = rows.select(F.struct(*rows.columns).alias("search"))
    row = row.withColumns({"n": strip(F.coalesce("search.ContractNumber", F.lit(""))), "e": fold_entity(F.col("search.EntityName")), "names": contractor_names(F.col("search.Contractors"))})
    t = targets.select("position", F.col("contract_number").alias("n"), fold_entity(F.col("entity")).alias("e"), F.col("contractor").alias("target_contractor"))
    fits = is_original(F.col("search.Amendment")) & ((F.size("names") == 0) | family_among(F.col("target_contractor"), F.col("names")))
    return t.join(row, ["n", "e"]).where(fits).select("position", "search")


def detail_reason(number: Column, entity: Column, contractor: Column) -> Column:
    """The first reason why a detail record is not the target's original; null if it is."""
    own = F.coalesce("contractor", F.lit(""))
    names = F.when(own != "", F.array(own)).when(F.size(F.coalesce("contractor_names", F.array().cast("array<string>"))) > 0, F.col("contractor_names")).otherwise(F.array(F.lit("")))
    return (
        F.when(~is_original(F.col("amendment")), NOT_ORIGINAL)
        .when(F.coalesce("contract_number", F.lit("")) != number, WRONG_NUMBER)
        .when(fold_entity(F.col("entity")) != fold_entity(entity), WRONG_ENTITY)
        .when(~family_among(contractor, names), WRONG_CONTRACTOR)
        .when(F.col("award_date").isNull(), NO_DATE)
    )


def enriched(records: DataFrame, search: str, source_type: str) -> DataFrame:
    """Records whose null, blank and zero values are filled from the struct column ``search`` (a search record, or null);
    links are the search record's first. The hash is made anew."""
    other = lambda c: F.col(f"{search}.{c}")
    have = F.col(search).isNotNull()
    filled = {}
    for c in RECORD:
        own, blank = F.col(c), F.col(c).isNull()
        blank = blank | (F.col(c) == 0) if c in ("amount", "amount_receivable", "cancelled") else blank if c in ("award_date", "valid_from", "valid_to") else blank | (F.col(c) == "")
        given = other(c).isNotNull() if c in ("amount", "amount_receivable", "cancelled", "award_date", "valid_from", "valid_to") else F.coalesce(other(c), F.lit("")) != ""
        filled[c] = F.when(have & blank & given, other(c)).otherwise(own)
    first = lambda c: F.when(have, F.coalesce(F.nullif(other(c), F.lit("")), F.col(c))).otherwise(F.col(c))
    filled |= {"source_type": F.when(have, F.lit(source_type)).otherwise(F.col("source_type")), "source_url": first("source_url"), "source_contract_id": first("source_contract_id"), "document_url": first("document_url")}
    got = records.withColumns(filled)
    return got.withColumn("row_hash", row_hash(*(F.col(c) for c in ("contract_number", "entity", "contractor", "amendment", "award_date", "amount"))))


def same_record(a: str, b: str) -> Column:
    """Whether two structs agree in all columns of a record; null is equal to null, and to 0 in cancelled."""
    parts = [F.coalesce(f"{a}.{c}", F.lit(0)) == F.coalesce(f"{b}.{c}", F.lit(0)) if c == "cancelled" else F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in RECORD]
    return reduce(lambda x, y: x & y, parts)


def enrichment_match(a: str, b: str) -> Column:
    """Whether two originals, structs with their ``family``, are one contract that only differs in detail: number, entity,
    amount and dates agree; entity code and family agree where both have them; what is receivable agrees, absent being 0."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same = reduce(lambda p, q: p & q, (x(c).eqNullSafe(y(c)) for c in ("contract_number", "entity", "amount", "award_date", "valid_from", "valid_to")))
    return same & is_original(x("amendment")) & is_original(y("amendment")) & shown.equal_if_present(x("entity_number"), y("entity_number")) & shown.equal_or_zero(x("amount_receivable"), y("amount_receivable")) & shown.equal_if_present(x("family"), y("family"))


def with_family(df: DataFrame) -> DataFrame:
    """The rows with their contractor's family, worked out once where they lack it."""
    return df if "family" in df.columns else df.withColumn("family", contractor_family(F.col("contractor")))


def with_earlier(got: DataFrame) -> DataFrame:
    """Records (rec, row_hash, twin, parent, rank) that meet nothing, but for the first by ``rank`` of each number and
    entity, get that first one as twin or parent: it was written before them."""
    meets_none = F.col("twin").isNull() & F.col("parent").isNull()
    first = F.min_by(F.struct("rank", "rec", "row_hash"), "rank").alias("written")
    opened = got.where(meets_none).groupBy(F.col("contract_number").alias("n"), F.col("entity").alias("x")).agg(first)
    both = got.join(opened, (F.col("contract_number") == F.col("n")) & (F.col("entity") == F.col("x")), "left").drop("n", "x")
    later = meets_none & (F.col("rank") > F.col("written.rank"))
    return both.withColumns({
        "twin": F.when(later & (F.col("row_hash") == F.col("written.row_hash")), F.col("written.rec")).otherwise(F.col("twin")),
        "parent": F.when(later, F.col("written.rec")).otherwise(F.col("parent")),
    }).drop("written")


def conflicts(records: DataFrame, known: DataFrame, recovered: DataFrame, in_order: bool = False) -> DataFrame:
    """The records with the kind of their conflict and its note. The first known row (contracts by id, then recovered
    rows by ``pos``) of the same hash decides; if there is none, the first original of the same number and entity.
    ``in_order``: records have a ``rank``, and those that are written count as recovered rows for later ones."""
    side = lambda df, rank, pos: df.select(F.struct(F.lit(rank).alias("rank"), F.col(pos).cast("long").alias("pos")).alias("at"), "row_hash", F.struct(*RECORD, "family").alias("e"))
    names, records, known, recovered = records.columns, *map(with_family, (records, known, recovered))
    rows = side(known, 0, "id").unionAll(side(recovered, 1, "pos"))
    by_hash = rows.join(records.select("row_hash").distinct(), "row_hash", "left_semi").groupBy("row_hash").agg(F.min_by("e", "at").alias("twin"))
    originals = rows.where(is_original(F.col("e.amendment"))).select(F.col("e.contract_number").alias("n"), F.col("e.entity").alias("x"), "e", "at")
    asked = records.select(F.col("contract_number").alias("n"), F.col("entity").alias("x")).distinct()
    by_family = originals.join(asked, ["n", "x"], "left_semi").groupBy("n", "x").agg(F.min_by("e", "at").alias("parent"))
    got = records.withColumn("rec", F.struct(*RECORD, "family")).join(by_hash, "row_hash", "left").join(by_family, (F.col("contract_number") == F.col("n")) & (F.col("entity") == F.col("x")), "left").drop("n", "x")
    if in_order:
        checkpoint_dir(records.sparkSession)
        got = with_earlier(got.checkpoint())  # at most one row for each target
    live = lambda s: F.col(f"{s}.source_type") == "live_recovery"

    def rules(start, s: str, equal: str) -> Column:
        have = F.col(s).isNotNull()
        match = have & enrichment_match(s, "rec")
        pair = lambda kind, why: F.struct(F.lit(kind).alias("kind"), F.lit(why).alias("note"))
        return start.when(have & same_record(s, "rec"), pair("identical", equal)).when(match & live(s), pair("identical", SAME_ROW)).when(match, pair("needs_enrichment", DEFER))

    pair = lambda kind, why: F.struct(F.lit(kind).alias("kind"), F.lit(why).alias("note"))
    chain = rules(F, "twin", SAME_ROW).when(F.col("twin").isNotNull(), pair("hash_conflict", COLLISION))
    chain = rules(chain, "parent", SAME_ORIGINAL)
    chain = chain.when(F.col("parent").isNotNull() & (F.col("parent.family") != F.col("rec.family")), pair("family_conflict", OTHER_FAMILY)).when(F.col("parent").isNotNull(), pair("family_conflict", OTHER_ROW))
    return got.withColumn("conflict", chain.otherwise(pair("ok", READY))).select(*names, F.col("conflict.kind").alias("conflict"), F.col("conflict.note").alias("conflict_note"))


class Recovery(NamedTuple):
    """``outcomes`` (position, status, notes, conflict) of all targets; ``added``, the records to write."""

    outcomes: DataFrame
    added: DataFrame


def recover(targets: DataFrame, rows: DataFrame, pages: DataFrame, entities: DataFrame, known: DataFrame, recovered: DataFrame, base_url: str, dry_run: bool = False) -> Recovery:
    """Work on all targets in their order. ``rows``: search rows; ``pages``: detail pages (url, html) as far as they could
    be had; ``entities``: (name, code). In a ``dry_run`` nothing is written, so no target sees another's record."""
    told, asked = asked_pages(targets, rows, entities, base_url)
    checkpoint_dir(targets.sparkSession)
    return resolved(told, checked_pages(targets, asked, pages, base_url).checkpoint(), known, recovered, dry_run)


def asked_pages(targets: DataFrame, rows: DataFrame, entities: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """Targets with how their candidates were found, and the pages to look at: (position, url, search), a target's own or
    those of its search rows. ``search`` is the search row that fills a page's blanks: for a target's own page the one
    with the same contract, if the search finds it."""
    manual, own = F.col("lookup_mode") == "manual_url", F.nullif(strip(F.coalesce("source_url", F.lit(""))), F.lit(""))
    coded = targets.withColumn("entity_key", fold_entity(F.col("entity"))).join(entity_codes(entities), "entity_key", "left")
    found = candidates(coded.where("code is not null"), rows)
    modes = coded.select("position", manual.alias("manual"), own.alias("own"))
    searched = found.join(modes.where("not manual"), "position").select("position", shown.detail_url(base_url, F.col("search.ContractId")).alias("url"), "search")
    same = found.select(F.col("position").alias("p"), F.col("search.ContractId").cast("string").alias("i"), F.col("search").alias("row")).groupBy("p", "i").agg(F.first("row").alias("search"))
    by_url = modes.where("manual and own is not null").withColumn("contract", shown.contract_id_of(F.col("own")))
    by_url = by_url.join(same, (F.col("position") == F.col("p")) & (F.col("contract") == F.col("i")), "left").select("position", F.col("own").alias("url"), "search")
    return discovered(targets, entities, searched), searched.unionByName(by_url)


def checked_pages(targets: DataFrame, asked: DataFrame, pages: DataFrame, base_url: str) -> DataFrame:
    """(position, url, missing, reason, and a record with its hash) of each page asked for: whether it could not be had,
    why it is not the target's original, and what it says, its blanks filled from the search row."""
    wanted = pages.select("url", "html").join(asked.select("url").distinct(), "url", "left_semi").dropDuplicates(["url"])
    details = detail_records(wanted, "live_recovery").select(F.col("source_url").alias("page_url"), F.struct(*RECORD, "row_hash", "contractor_names").alias("page"))
    met = asked.join(details, F.col("url") == F.col("page_url"), "left").withColumn("searched", F.col("search").isNotNull())
    met = search_records(met.select("position", "url", "searched", "page", "search.*"), base_url, "live_recovery", ("position", "url", "searched", "page"))
    met = met.select("position", "url", F.col("page").isNull().alias("missing"), "page", F.when(F.col("searched"), F.struct(*RECORD)).alias("search_record"))
    wants = targets.select("position", F.col("contract_number").alias("tn"), F.col("entity").alias("te"), F.col("contractor").alias("tc"))
    met = met.join(wants, "position").select("position", "url", "missing", "search_record", "tn", "te", "tc", "page.*")
    met = met.withColumn("reason", F.when(~F.col("missing"), detail_reason(F.col("tn"), F.col("te"), F.col("tc"))))
    return enriched(met, "search_record", "live_recovery").select("position", "url", "missing", "reason", *RECORD, "row_hash")


def resolved(targets: DataFrame, checked: DataFrame, known: DataFrame, recovered: DataFrame, dry_run: bool = False) -> Recovery:
    """The outcome of every target. ``targets``: position, status, rank, discovery (the note on how candidates were
    found), found (whether any were) and askable; ``checked``: position, url, missing, reason (null if valid) and the
    record of each candidate's page. Targets that cannot be looked up keep their status."""
    had = checked.where("not missing")
    valid = had.where("reason is null").dropDuplicates(["position", *RECORD])
    counts = valid.groupBy("position").agg(F.count("*").alias("n_valid"))
    reasons = had.where("reason is not null").groupBy("position").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))  # at most five texts
    lost = checked.where("missing").groupBy("position").agg(F.min("url").alias("lost"))
    single = valid.join(counts.where("n_valid = 1").select("position"), "position", "left_semi").join(lost, "position", "left_anti").drop("url", "missing", "reason")
    kinds = conflicts(single.join(targets.select("position", "rank"), "position"), known, recovered, not dry_run).withColumnsRenamed({"position": "p"})
    got = targets.join(counts, "position", "left").join(reasons, "position", "left").join(lost, "position", "left").join(kinds.select("p", "conflict", "conflict_note"), F.col("position") == F.col("p"), "left")
    n, error = F.coalesce("n_valid", F.lit(0)), F.concat(F.lit("error: no page for "), F.col("lost"))
    status = F.when(~F.col("askable") | (F.col("found") & F.col("lost").isNotNull()), F.col("status")).when(~F.col("found") | (n == 0), "unrecoverable").when(n > 1, "ambiguous")
    status = status.when(F.col("conflict").isin("ok", "identical"), "recovered").when(F.col("conflict") == "needs_enrichment", "unrecoverable").otherwise("ambiguous")
    why = F.when(~F.col("found"), F.lit("")).when(n == 0, F.coalesce("reasons", F.lit(""))).when(n > 1, F.concat(n.cast("string"), F.lit(" validated candidates remain"))).when(F.col("conflict") == "ok", RECOVERED).otherwise(F.col("conflict_note"))
    notes = F.when(~F.col("askable"), NO_URL).when(F.col("found") & F.col("lost").isNotNull(), error).otherwise(shown.note(F.col("discovery"), why))
    added = kinds.where(F.col("conflict") == "ok").select(F.col("p").alias("position"), *RECORD, "row_hash")
    return Recovery(got.select("position", status.alias("status"), notes.alias("notes"), F.col("conflict")), added.limit(0) if dry_run else added)


def discovered(targets: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """Targets (position, status, rank) with how their candidates were found: by their own URL (``askable`` if they have
    one), or by a search that needs the one code of their entity. ``found``: the search's candidates (position)."""
    counts = found.groupBy("position").agg(F.count("*").alias("n"))
    got = targets.withColumn("rank", target_rank()).withColumn("entity_key", fold_entity(F.col("entity"))).join(entity_codes(entities), "entity_key", "left").join(counts, "position", "left")
    manual, n = F.col("lookup_mode") == "manual_url", F.coalesce("n", F.lit(0))
    search = F.when(F.col("code").isNull(), NO_ENTITY).otherwise(F.concat(F.lit("search returned "), n.cast("string"), F.lit(" exact candidate(s)")))
    askable = ~manual | (strip(F.coalesce("source_url", F.lit(""))) != "")
    return got.select("position", "status", "rank", F.when(manual, MANUAL).otherwise(search).alias("discovery"), (manual | (F.col("code").isNotNull() & (n > 0))).alias("found"), askable.alias("askable"))


def upserted(recovered: DataFrame, records: DataFrame) -> DataFrame:
    """Recovered rows (with ``pos``) and new records: a record that equals a row replaces the first such row, all others
    are appended (``pos`` null)."""
    key = F.to_json(F.struct(*(F.coalesce(c, F.lit(0)).alias(c) if c == "cancelled" else F.col(c) for c in RECORD)))
    have, new = recovered.withColumn("__key", key), records.select(*RECORD).withColumn("__key", key).dropDuplicates(["__key"])
    first = have.groupBy("__key").agg(F.min("pos").alias("pos"))
    replaced, added = new.join(first, "__key"), new.join(first, "__key", "left_anti").withColumn("pos", F.lit(None).cast("long"))
    rest = have.join(replaced.select("__key", "pos"), ["__key", "pos"], "left_anti")
    names = [*RECORD, "pos"]
    return rest.select(*names).unionByName(replaced.select(*names)).unionByName(added.select(*names))
