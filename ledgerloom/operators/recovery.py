"""Families without their original row: finding them, tracking and joining their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import parse
from ledgerloom.functions.text import clean, contractor_family, fold, fold_entity, is_original, strip
from ledgerloom.session import dealt
from ledgerloom.sources.contracts import TARGET

# The ways of looking a target up, and its states.
MODES, STATUSES = ("manual_url", "auto_discover"), ("pending", "recovered", "unrecoverable", "ambiguous")


def recovery_batch() -> Column:
    """The first of the fiscal year and the years of the three dates that is known."""
    years = [parse.fiscal_year(F.col(c)) for c in ("award_date", "valid_from", "valid_to")]
    return F.coalesce(F.nullif(F.trim("fiscal_year"), F.lit("")), *years)


def scan_order() -> Column:
    """Rows by their first known date, then those with only a batch by its year, then all others; by id in each."""
    day = F.coalesce("award_date", "valid_from", "valid_to")
    start = parse.fiscal_year_start(recovery_batch())
    level = F.when(day.isNotNull(), 0).when(start.isNotNull(), 1).otherwise(2)
    return F.struct(level.alias("level"), F.coalesce(F.unix_date(day), start, F.lit(0)).alias("k"), F.col("id"))


def family_scan(rows: DataFrame) -> DataFrame:
    """Each family by folded keys, the entity's without its code: rows, whether it has an original, and number, entity,
    contractor and batch of its earliest row as they stand there. Rows without number or entity are left out; a
    representative without batch takes the first batch by id."""
    plain = {c: strip(F.coalesce(c, F.lit(""))) for c in ("contract_number", "entity", "contractor")}
    known = rows.withColumns(plain).where("contract_number <> '' and entity <> ''").withColumn("batch", recovery_batch())
    keys = ["number_key", "entity_key", "family"]
    keyed = known.withColumns({"number_key": fold(F.col("contract_number")), "entity_key": fold_entity(F.col("entity"))})
    got = dealt(keyed, *keys).groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.max(is_original(F.col("amendment")).cast("int")).alias("has_original"),
        F.min_by(F.struct("contract_number", "entity", "contractor", "batch", "id"), scan_order()).alias("rep"),
        F.min_by("batch", F.when(F.col("batch").isNotNull(), F.col("id"))).alias("any_batch"),
    )
    return got.select("number_key", "entity_key", "family", "row_count", "has_original", "rep.contract_number", "rep.entity", "rep.contractor", F.coalesce("rep.batch", "any_batch").alias("recovery_batch"), F.col("rep.id").alias("rep_id"))


def missing_originals(scan: DataFrame, batches: tuple[str, ...] = ()) -> DataFrame:
    got = scan.where("row_count > 1 and has_original = 0")
    return got.where(F.coalesce("recovery_batch", F.lit("")).isin(*batches)) if batches else got


def targets(scan: DataFrame) -> DataFrame:
    """Targets of the missing originals, with states and modes that follow their ids (a stand-in for a tracking file)."""
    k = F.col("rep_id") % 4
    return missing_originals(scan).select(
        "contract_number", "entity", "contractor", "family", "recovery_batch",
        F.get(F.array(*map(F.lit, ("auto_discover", "manual_url", "auto_discover", "guess"))), k.cast("int")).alias("lookup_mode"),
        F.when(k == 1, "https://example.org/contract").alias("source_url"),
        F.get(F.array(*map(F.lit, STATUSES)), k.cast("int")).alias("status"),
        F.when(k == 2, "no candidate").alias("notes"), F.col("rep_id").alias("position"),
    )


def publishable(t: DataFrame) -> DataFrame:
    """The targets that are not pending, those without a status among them, with their text cleaned."""
    return t.withColumns({c: clean(F.col(c)) for c in TARGET if c in t.columns}).where(~F.col("status").eqNullSafe("pending"))


def violations(t: DataFrame) -> DataFrame:
    """Targets that a file must not hold, with the first reason."""
    reason = F.when(~F.col("lookup_mode").isin(*MODES), "unknown lookup mode").when(~F.col("status").isin(*STATUSES), "unknown status").when(F.trim(F.coalesce("recovery_batch", F.lit(""))) == "", "no batch")
    return t.withColumn("reason", reason).where("reason is not null")


def selected(t: DataFrame, statuses=("pending",), batches: tuple[str, ...] = (), limit: int = 100, contract_number: str | None = None, all_pending: bool = False) -> DataFrame:
    """Targets to work on: pending ones and those of further ``statuses``. Without a batch, a contract number or
    ``all_pending``, more than ``limit`` are refused."""
    unknown = set(statuses) - set(STATUSES)
    if unknown:
        raise ValueError(f"unknown status {sorted(unknown)[0]}")
    got = t.where(F.col("status").isin("pending", *statuses) & F.col("lookup_mode").isin(*MODES) & ((F.col("lookup_mode") != "manual_url") | (F.coalesce("source_url", F.lit("")) != "")))
    if contract_number:
        got = got.where(F.col("contract_number") == contract_number)
    if batches:
        got = got.where(F.coalesce("recovery_batch", F.lit("")).isin(*(b.strip() for b in batches)))
    if not (contract_number or batches or all_pending) and got.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} targets: name a batch")
    return got


def checked_file(t: DataFrame) -> DataFrame:
    """The targets, or an error that names the first violation."""
    bad = violations(t).select("reason", "contract_number").first()
    if bad:
        raise ValueError(f"{bad['reason']}: {bad['contract_number']}")
    return t


def target_order() -> list[Column]:
    """Newest batch first, texts that are no batch last, then number, folded entity, family and mode."""
    start = parse.fiscal_year_start(F.col("recovery_batch"))
    return [F.coalesce(-start, F.lit(10**9)), F.coalesce(F.trim("recovery_batch"), F.lit("")), F.coalesce("contract_number", F.lit("")), fold_entity(F.col("entity")), contractor_family(F.col("contractor")), F.coalesce("lookup_mode", F.lit(""))]


def target_rank() -> Column:
    """A target's place in this order, equal ones by their place in the file, as one value to compare."""
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(target_order())), F.col("position"))


def identity() -> list[Column]:
    """What makes targets, and families of a scan, the same."""
    return [fold(F.col("contract_number")).alias("number_key"), fold_entity(F.col("entity")).alias("entity_key"), contractor_family(F.col("contractor")).alias("family")]


def rank_of(row: dict) -> tuple:
    """What makes one of two duplicate targets the preferred one."""
    # The ranks of the states.
    ranks = {"pending": 0, "ambiguous": 1, "unrecoverable": 2, "recovered": 3}
    return (ranks.get(row["status"], -1), row["lookup_mode"] == "manual_url", bool(row["source_url"]), bool(row["notes"]), row["last_checked_at"] or "")


def folded_duplicates(t: DataFrame) -> DataFrame:
    """Targets with one identity folded into one, in file order: of each two the preferred keeps its values and takes the
    other's for its blanks, and the later check. ``folded`` counts those that went. The winner of a pair changes by what
    it takes, so the order matters: rows are dealt by identity, sorted by position inside each task and read as a
    stream, one state at a time; targets without a second one pass through as they are."""
    import numpy as np
    import pyarrow as pa

    keys, fields = ["number_key", "entity_key", "family"], [c for c in TARGET if c != "last_checked_at"]
    keyed = t.select(*identity(), *TARGET, "position").withColumn("folded", F.lit(0).cast("long"))
    schema = pa.schema([(c, pa.int64() if c in ("position", "folded") else pa.string()) for c in keyed.columns])

    def merge(a: dict, b: dict) -> dict:
        best, other = (a, b) if rank_of(a) >= rank_of(b) else (b, a)
        out = {c: best[c] or other[c] for c in fields}
        times = [x["last_checked_at"] for x in (a, b) if x["last_checked_at"]]
        return a | out | {"last_checked_at": max(times, default=None), "folded": a["folded"] + 1}

    def run(batches):
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).cast(schema)
            same = np.ones(batch.num_rows - 1, bool)
            for k in keys:
                column = table[k].combine_chunks()
                same &= np.asarray(pa.compute.equal(column[1:], column[:-1]))
            first = np.append(0, np.flatnonzero(~same) + 1)
            size = np.diff(first, append=batch.num_rows)
            alone = size == 1
            alone[[0, -1]] = False  # these may go on in the batch before or after
            yield from table.take(pa.array(first[alone])).to_batches()
            done = []
            for at, n in zip(first[~alone].tolist(), size[~alone].tolist(), strict=True):
                for row in table.slice(at, n).to_pylist():
                    if state and all(state[k] == row[k] for k in keys):
                        state = merge(state, row)
                    else:
                        done += [state] if state else []
                        state = row
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([state], schema=schema)

    ordered = keyed.repartition(*keys).sortWithinPartitions(*keys, "position")
    return ordered.mapInArrow(run, ", ".join(f"{c} {'long' if c in ('position', 'folded') else 'string'}" for c in keyed.columns))


def seeded(t: DataFrame, scan: DataFrame, batches: tuple[str, ...] = ()) -> DataFrame:
    """The tracked targets, and new pending ones for families without an original that are not tracked. Tracked ones
    whose family has an original go unless they are recovered; a missing batch is taken from the family."""
    keys = ["number_key", "entity_key", "family"]
    side = scan.select(*keys, "has_original", F.col("recovery_batch").alias("scan_batch"))
    have = folded_duplicates(t).join(side, keys, "left")
    stays = have.where((F.coalesce("has_original", F.lit(0)) == 0) | F.col("status").eqNullSafe("recovered"))
    batch = F.when(F.trim(F.coalesce("recovery_batch", F.lit(""))) == "", F.col("scan_batch")).otherwise(F.col("recovery_batch"))
    stays = stays.withColumn("recovery_batch", batch).select(*keys, *TARGET)
    new = missing_originals(scan, batches).join(stays.select(*keys), keys, "left_anti")
    none = {c: F.lit(None).cast("string").alias(c) for c in ("source_url", "notes", "last_checked_at")}
    new = new.select(*keys, "contract_number", "entity", "contractor", "recovery_batch", F.lit("auto_discover").alias("lookup_mode"), none["source_url"], F.lit("pending").alias("status"), none["notes"], none["last_checked_at"])
    return stays.unionByName(new).drop(*keys)


def seed_counts(t: DataFrame, scan: DataFrame, batches: tuple[str, ...] = ()) -> DataFrame:
    """One row: targets added, candidate families, tracked targets removed, duplicates folded."""
    keys = ["number_key", "entity_key", "family"]
    folded = folded_duplicates(t).join(scan.select(*keys, "has_original"), keys, "left")
    gone = (F.coalesce("has_original", F.lit(0)) == 1) & ~F.col("status").eqNullSafe("recovered")
    of_targets = folded.agg(F.count_if(gone).alias("removed"), F.coalesce(F.sum("folded"), F.lit(0)).alias("collapsed"))
    candidates = missing_originals(scan, batches)
    added = candidates.join(folded.where(~gone).select(*keys), keys, "left_anti")
    return added.agg(F.count("*").alias("added")).join(F.broadcast(candidates.agg(F.count("*").alias("candidates")))).join(F.broadcast(of_targets))  # one row each


def pending_by_batch(t: DataFrame) -> DataFrame:
    return t.where("status = 'pending'").groupBy(F.coalesce("recovery_batch", F.lit("(missing)")).alias("batch")).agg(F.count("*").alias("pending"))


def by_status(t: DataFrame) -> DataFrame:
    return t.groupBy("status").agg(F.count("*").alias("targets"))


def with_targets(rows: DataFrame, t: DataFrame) -> DataFrame:
    """Rows with the first target of their number and entity whose family is theirs, or any for a blank family."""
    from ledgerloom.operators.families import first_target

    keys = ["contract_number", "entity", "family"]
    found = first_target(rows, t, keys).select(*(F.col(k).alias(f"t_{k}") for k in keys), F.col("target.status").alias("recovery_status"))
    return rows.join(found, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys], "left").select("id", "recovery_status")
