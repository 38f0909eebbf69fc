"""Loading: first-wins dedup, anti join with what is stored, logs, snapshots and the year calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import parse, shown, text
from ledgerloom.operators import dashboard
from ledgerloom.session import checkpoint_dir, dealt, many_parts, written
from ledgerloom.sources.contracts import TARGET

# The published columns; those of exports and printed lists of families and of rows, in their order.
PUBLISHED = ["id", "contract_number", "entity", "entity_number", "contractor", "amendment", "service_category", "service_type", "amount", "amount_receivable", "award_date", "valid_from", "valid_to", "procurement_method", "fund_type", "pco_number", "cancelled", "document_url", "fiscal_year", "source_type", "source_url", "source_contract_id"]
SUMMARY = ["contract_number", "contractor", "entity", "amount", "award_date", "valid_from", "valid_to", "service_category", "service_type", "fiscal_year", "family_size", "family_total_amount", "procurement_method", "fund_type"]
DETAILED = ["contract_number", "amendment", "contractor", "entity", "entity_number", "amount", "amount_receivable", "award_date", "valid_from", "valid_to", "service_category", "service_type", "fiscal_year", "procurement_method", "fund_type", "pco_number", "cancelled", "document_url", "source_type", "source_contract_id", "source_url"]
PRINTED_SUMMARY = ["contract_number", "contractor", "entity", "amount", "award_date", "valid_from", "valid_to", "service_category"]
PRINTED_DETAILED = ["contract_number", "amendment", "contractor", "entity", "amount", "award_date", "valid_from", "valid_to", "service_type", "source_type", "source_contract_id", "source_url"]
# Most rows of an export, and of printed lists of families and of rows.
EXPORT_CAP, PRINT_CAPS = 100_000, {"summary": 250, "detailed": 100}
# The first year of exports; years known only from an archive, and known to be absent.
FIRST_YEAR, ARCHIVE_ONLY, ABSENT = 2010, ("2010-2011", "2011-2012"), ("2023-2024",)
#: Columns that older tables and the given tables lack.
OPTIONAL = ("pco_number", "document_url", "source_url", "source_contract_id")


def first_wins(rows: DataFrame, order=("source_rank", "file", "pos")) -> DataFrame:
    """The first row of each hash in load order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("row_hash").orderBy(*order))).where("rn = 1").drop("rn")


def unseen(rows: DataFrame, stored: DataFrame) -> DataFrame:
    return rows.join(stored.select("row_hash").distinct(), "row_hash", "left_anti")


def load_log(rows: DataFrame, order=("source_rank", "file", "pos")) -> DataFrame:
    """Per file: rows parsed, rows new, rows already there. The first file of each hash is found by aggregation."""
    new = rows.groupBy("row_hash").agg(F.min_by("file", F.struct(*order)).alias("file")).groupBy("file").agg(F.count("*").alias("new_rows"))
    got = rows.groupBy("file").agg(F.count("*").alias("parsed")).join(new, "file", "left")
    return got.select("file", "parsed", F.coalesce("new_rows", F.lit(0)).alias("new_rows")).withColumn("duplicates", F.col("parsed") - F.col("new_rows"))


def load_ids(rows: DataFrame, order=("source_rank", "file", "pos"), parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 in load order: sorted by range, counted by partition, numbered inside each. The counts come
    to the driver, one for each partition."""
    checkpoint_dir(rows.sparkSession)
    ranged = rows.repartitionByRange(*([parts] if parts else []), *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").withColumn("id", F.col("before") + place).drop("__part", "before")


def calendar(spark, last: int, first: int = FIRST_YEAR) -> DataFrame:
    """Fiscal years from the first to the one that starts in ``last``, with flags for years that only an archive has and
    for years known to be absent."""
    year = parse.fiscal_year_of(F.col("id"))
    return spark.range(first, last + 1).select(year.alias("fiscal_year"), year.isin(*ARCHIVE_ONLY).alias("archive_only"), year.isin(*ABSENT).alias("known_absent"))


def year_gaps(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Fiscal years from ``first`` to ``last`` that the table lacks."""
    return calendar(rows.sparkSession, last, first).select("fiscal_year").join(rows.select("fiscal_year").distinct(), "fiscal_year", "left_anti")


def refresh_years(held: DataFrame, last: int) -> DataFrame:
    """Years to fetch again: from the newest held one that an archive does not alone provide, to the current one."""
    newest = held.where(~F.col("fiscal_year").isin(*ARCHIVE_ONLY)).agg(F.max("fiscal_year").alias("since"))
    return calendar(held.sparkSession, last).join(F.broadcast(newest)).where(F.col("since").isNull() | (F.col("fiscal_year") >= F.col("since"))).select("fiscal_year")  # one row


def aligned(rows: DataFrame, empty: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Rows with every column of ``empty``; a column that the rows lack has its default, a blank source type is csv."""
    kind = F.when(F.trim(F.coalesce("source_type", F.lit(""))) == "", "csv").otherwise(F.col("source_type"))
    given = {"source_type": "csv", "cancelled": 0} | (defaults or {})
    lacking = {c: F.lit(v) for c, v in given.items() if c in empty.columns and c not in rows.columns}
    return empty.unionByName(rows.withColumns(lacking), allowMissingColumns=True).withColumn("source_type", kind)


def snapshot(rows: DataFrame) -> DataFrame:
    """The published columns, text and dates normalised once more."""
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in rows.columns})
    kinds = dict(rows.dtypes)
    plain = lambda c: F.nullif(text.strip(F.replace(F.col(c), F.lit("\x00"), F.lit(""))), F.lit("")).alias(c)
    day = lambda c: (parse.date(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(c)
    return rows.select(*(day(c) if c in ("award_date", "valid_from", "valid_to") else plain(c) if kinds[c] == "string" else F.col(c) for c in PUBLISHED))


def change_report(rows: DataFrame, *keep: str) -> DataFrame:
    """The rows that normalising would change: id, and the dates and the amendment before (as stored text) and after.
    ``keep``: further columns to show."""
    names = ("award_date", "valid_from", "valid_to", "amendment")
    after = {c: parse.date(F.col(c)).cast("string") for c in names[:3]} | {"amendment": F.nullif(text.strip(F.replace(F.col("amendment"), F.lit("\x00"), F.lit(""))), F.lit(""))}
    both = rows.select("id", *keep, *(F.col(c).alias(f"{c}_before") for c in names), *(after[c].alias(f"{c}_after") for c in names))
    return both.where(reduce(lambda a, b: a | b, (~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")) for c in names)))


def rewritten(rows: DataFrame) -> DataFrame:
    """The rows with dates and amendment normalised."""
    return rows.withColumns({c: parse.date(F.col(c)).cast("string") for c in ("award_date", "valid_from", "valid_to")} | {"amendment": F.nullif(text.strip(F.replace(F.col("amendment"), F.lit("\x00"), F.lit(""))), F.lit(""))})


def publish(rows: DataFrame, path: str) -> None:
    """The snapshot, one folder for each fiscal year."""
    snapshot(rows).repartition("fiscal_year").sortWithinPartitions("award_date").write.mode("overwrite").partitionBy("fiscal_year").parquet(path)


def export(rows: DataFrame, mode: str = "summary", cap: int = EXPORT_CAP) -> DataFrame:
    """All rows found, newest first, with the columns of their mode: ``summary`` takes families as pages show them,
    ``detailed`` contract rows. None, or more than ``cap``, are refused. The search runs once, up to one row more than
    may be exported; what it found is kept in a table of the shared folder."""
    found = written(rows.limit(cap + 1), "export")
    n = found.count()
    if not 0 < n <= cap:
        raise ValueError("nothing to export" if not n else f"more than {cap} rows to export: narrow the search")
    return exported(found, mode)


def exported(rows: DataFrame, mode: str = "summary") -> DataFrame:
    """The columns of an export in their order, newest first."""
    detailed = mode == "detailed"
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in rows.columns})
    order = [F.desc_nulls_last("award_date"), F.desc("id") if detailed else F.asc("id")]
    parts = many_parts(rows)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts else rows.orderBy(*order)
    return rows.select(*(DETAILED if detailed else SUMMARY))


def printed(rows: DataFrame, mode: str = "summary") -> DataFrame:
    """A printed list: fewer columns, money and dates as people read them, and refused beyond its cap."""
    return export(rows, mode, PRINT_CAPS[mode]).transform(lambda df: for_print(df, mode))


def for_print(rows: DataFrame, mode: str) -> DataFrame:
    """The columns of a printed list, formatted."""
    form = {"amount": shown.money_text(F.col("amount"))} | {c: shown.long_date(F.col(c).cast("string")) for c in ("award_date", "valid_from", "valid_to")}
    return rows.select(*(form[c].alias(c) if c in form else c for c in (PRINTED_DETAILED if mode == "detailed" else PRINTED_SUMMARY)))


def write_csv(rows: DataFrame, path: str) -> None:
    """An export as CSV with quotes doubled."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def manifest_parts(rows: DataFrame, board: DataFrame, targets: DataFrame, archived: tuple[str, ...] = ()) -> DataFrame:
    """(section, place, text): the manifest of the register as pieces of one JSON document, which they are when put
    together by section and place. The first piece has the statistics, years (newest first, or the ``archived`` ones) and
    dashboard, which are lists of a few rows; then each target is a piece of its own in file order (``position``); the
    last closes the document. Nothing gathers the targets. Nulls are written; a null status is none that is pending."""
    as_json = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    exact = lambda c: F.col(c).cast("decimal(18,2)").alias("total_amount")

    def listed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
        """A list of few rows, as a one-row table."""
        shown_ = F.struct(F.col("name") if "name" in df.columns else F.col("fiscal_year"), F.col("families").alias("family_count"), exact("money"))
        got = df.agg(F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), shown_.alias("shown")))).alias("l"))
        return got.select(F.to_json(F.transform("l", lambda x: x["shown"]), {"ignoreNullFields": "false"}).alias(name))

    money_down = -F.col("money").cast("decimal(18,2)")
    years = F.sort_array(F.collect_set("fiscal_year"), asc=False)
    facts = rows.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")), F.lit(0)).cast("decimal(28,2)").alias("total_amount"), years.alias("held"))
    given = F.array(*map(F.lit, archived)) if archived else F.col("held")
    lists = (
        listed(dashboard.top_contractors(board, years=archived).withColumn("name", F.col("contractor")), [money_down, -F.col("families"), F.col("family")], "top_contractors"),
        listed(dashboard.top_entities(board, years=archived).withColumn("name", F.col("entity")), [money_down, -F.col("families"), F.col("entity")], "top_entities"),
        listed(dashboard.by_year(board, archived), [F.col("fiscal_year")], "yearly_spending"),
    )
    for part in lists:
        facts = facts.join(F.broadcast(part))  # one row each
    quoted = lambda name: F.concat(F.lit(f'"{name}":'), F.col(name))
    stats = as_json("row_count", "total_amount", given.alias("fiscal_years"), given.alias("archived_csv_fiscal_years"))
    head = F.concat(F.substring(stats, F.lit(1), F.length(stats) - 1), F.lit(',"dashboard":{'), F.concat_ws(",", *map(quoted, ("top_contractors", "top_entities", "yearly_spending"))), F.lit('},"recovery_targets":['))
    piece = lambda section, place, c: (F.lit(section).alias("section"), place.cast("long").alias("place"), c.alias("text"))
    first = F.broadcast(targets.agg(F.min("position").alias("first")))  # one row
    comma = F.when(F.col("position") == F.col("first"), "").otherwise(",")
    middle = targets.join(first).select(*piece(1, F.col("position"), F.concat(comma, as_json(*TARGET))))
    one = rows.sparkSession.range(1)
    return facts.select(*piece(0, F.lit(0), head)).unionByName(middle).unionByName(one.select(*piece(2, F.lit(0), F.lit("]}"))))


def write_manifest(parts: DataFrame, path: str) -> None:
    """The pieces as sorted text files: read one after another by name they are the document."""
    parts.orderBy("section", "place").select("text").write.mode("overwrite").text(path)


def digest(new: DataFrame, most: int = 50) -> DataFrame:
    """What a message about new rows lists: the first ``most`` by id with amounts as text, and how many more there are."""
    more = new.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    amount = F.when(F.coalesce("amount", F.lit(0.0)) == 0, "N/A").otherwise(shown.money_text(F.col("amount")))
    return new.orderBy("id").limit(most).join(F.broadcast(more)).select("id", "entity", "contractor", amount.alias("amount_text"), "award_date", "contract_number", "more")


def start_date(explicit: str | None, last_success: str | None, today: str, days: int = 7) -> str:
    """The cursor: the date given, else the last success, else ``days`` before today."""
    import datetime

    return explicit or last_success or str(datetime.date.fromisoformat(today) - datetime.timedelta(days))


def since(rows: DataFrame, explicit: str | None = None, last_success: str | None = None, today: str | None = None, days: int = 7) -> DataFrame:
    """Rows awarded on or after the cursor: the date given, else the last success, else ``days`` before today."""
    start = F.lit(explicit or last_success).cast("date") if explicit or last_success else F.date_sub(F.lit(today).cast("date") if today else F.current_date(), days)
    return rows.where(F.col("award_date") >= start)
