"""The store of records by content hash, the state of its loads, and rewrites of what a change touches.

Records lie in folders by the first sign of their hash; each load writes files of disjoint ranges of hashes, sorted inside,
with a Bloom filter of the hashes in each row group. Whether the hashes of a batch are known is then asked of the folders of its prefixes only,
and, for a batch of few hashes, of the row groups and pages whose range and filter allow one: what is read follows the
batch and not the store.

Each load leaves one row of state (its key, number, cursor and counts), written after its records, as one file that is
there whole or not at all. A load that fails before leaves the cursor where it was; run again, it adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import loading
from ledgerloom.session import many_parts, release, written
from ledgerloom.sources.contracts import exists

#: Signs of a hash that name its folder: 16 folders.
PREFIX = 1
#: A batch of so many distinct hashes at most is asked for by value, a larger one by its folders.
BY_VALUE = 10_000
STATE = "key string, number long, cursor string, seen long, added long, known long"


def part_of(column: str = "row_hash"):
    return F.substring(column, 1, PREFIX)


def add(rows: DataFrame, path: str) -> None:
    """Append records to the store."""
    lay(ranged(rows, many_parts(rows)), path)


def ranged(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt by ranges of hashes, ``parts`` of them or the session's number."""
    return rows.repartitionByRange(*([parts] if parts else []), "row_hash")


def lay(rows: DataFrame, path: str) -> None:
    """Append records that lie in ranges of hashes. A filter takes the size that its hashes need."""
    laid = rows.withColumn("part", part_of()).sortWithinPartitions("part", "row_hash")
    filters = {"parquet.bloom.filter.enabled#row_hash": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    laid.write.mode("append").options(compression="zstd", **filters).partitionBy("part").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store's records."""
    return spark.read.option("mergeSchema", False).parquet(path).withColumn("part", F.col("part").cast("string"))


def hashes_near(batch: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """The store's hashes among which those of a batch are: these alone (True) if they are few, else all of the batch's
    folders. The folders (at most 16), and the hashes if they are few, come to the driver and reach the scan as filters."""
    spark = batch.sparkSession
    if not exists(spark, path):
        return spark.createDataFrame([], "row_hash string"), True
    hashes = batch.select("row_hash").distinct()
    few = hashes.limit(BY_VALUE + 1).collect()
    table = stored(spark, path)
    if len(few) <= BY_VALUE:
        values = [r["row_hash"] for r in few if r["row_hash"] is not None]
        return table.where(F.col("part").isin({v[:PREFIX] for v in values}) & F.col("row_hash").isin(values)).select("row_hash"), True
    parts = [r["part"] for r in batch.select(part_of().alias("part")).distinct().collect()]
    return table.where(F.col("part").isin(parts)).select("row_hash"), False


def known_hashes(batch: DataFrame, path: str) -> DataFrame:
    """The hashes of a batch that the store has."""
    near, only = hashes_near(batch, path)
    return (near if only else near.join(batch.select("row_hash").distinct(), "row_hash", "left_semi")).distinct()


def unseen(batch: DataFrame, path: str) -> DataFrame:
    """The records of a batch whose hash the store lacks."""
    return batch.join(known_hashes(batch, path), "row_hash", "left_anti")


def loads(spark: SparkSession, state: str) -> DataFrame:
    """The state of all loads."""
    return spark.read.schema(STATE).parquet(state) if exists(spark, state) else spark.createDataFrame([], STATE)


def last_cursor(spark: SparkSession, state: str) -> str | None:
    """The cursor of the last load that ended well."""
    last = loads(spark, state).where("cursor is not null").agg(F.max_by("cursor", "number").alias("cursor")).first()
    return last["cursor"]


def load(rows: DataFrame, path: str, state: str, key: str, cursor: str | None = None, order: tuple[str, ...] = ("source_rank", "file", "pos")) -> dict:
    """Add the first row of each hash that the store lacks, and then the load's state. A load whose ``key`` has its state
    already does nothing. One that failed after adding records is completed when it is run again: records carry the key
    of their load, by which it counts what it really added."""
    spark = rows.sparkSession
    before = loads(spark, state)
    done = before.where(F.col("key") == key).first()
    if done:
        return done.asDict()
    number = (before.agg(F.max("number")).first()[0] or 0) + 1
    seen, parts = rows.count(), many_parts(rows)
    near, _ = hashes_near(rows, path)
    both = rows.withColumn("__known", F.lit(False)).unionByName(near.where("row_hash is not null").withColumn("__known", F.lit(True)), allowMissingColumns=True)
    at = Window.partitionBy("row_hash").orderBy(F.desc("__known"), *order)
    # the ranges in which records are laid hold all rows of a hash, so rows move once
    new = ranged(both, parts).withColumn("__place", F.row_number().over(at)).where("__place = 1 and not __known")
    lay(new.drop("__place", "__known").withColumn("load", F.lit(key)), path)
    # one value of "load" in each file: its statistics tell which files to read
    added = stored(spark, path).where(F.col("load") == key).count() if exists(spark, path) else 0
    if parts:
        release(spark)  # the shuffle files of a large load
    row = {"key": key, "number": number, "cursor": cursor, "seen": seen, "added": added, "known": seen - added}
    spark.createDataFrame([tuple(row.values())], STATE).coalesce(1).write.mode("append").parquet(state)
    return row


def sync(fetch, spark: SparkSession, path: str, state: str, today: str, explicit: str | None = None, days: int = 7) -> dict:
    """One run of a synchronisation: the rows that ``fetch`` (a function of the start date) finds since the cursor are
    loaded, and ``today`` becomes the cursor. If anything fails the cursor stays."""
    start = loading.start_date(explicit, last_cursor(spark, state), today, days)
    attempt = loads(spark, state).count()
    return load(fetch(start), path, state, f"sync {start} {today} {attempt}", today)


def rewrite_changed(spark: SparkSession, path: str, by: str = "fiscal_year") -> list:
    """Normalise the dates and amendments of a table in folders of the column ``by``, and overwrite those folders alone
    whose rows change; their values are returned. The new rows are written aside first, then put in place folder by
    folder, so a run that fails in between leaves each folder old or new, and running again does the rest."""
    table = spark.read.parquet(path)
    touched = sorted(r[0] for r in loading.change_report(table, by).select(by).distinct().collect())  # a value for each folder
    if touched:
        aside = written(loading.rewritten(table.where(F.col(by).isin(touched))), "rewritten")
        aside.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return touched
