"""Families kept up to date: a stored roll-up of mergeable parts, refreshed for what a load touches.

A family's part holds its number of rows, the exact sum of their amounts, whether it has an original, its earliest date
and the least of (order, row), which is its representative. Parts of two sets of rows make the part of both. They lie in
folders by a hash of the family's keys; a load of new rows reads and overwrites the folders of the families it touches,
each marked with the load's number, so a load that is run again leaves alone what it has done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.families import KEYS, REP, member_order
from ledgerloom.functions.text import is_original
from ledgerloom.session import many_parts, release
from ledgerloom.sources.contracts import exists

#: Folders of a stored roll-up.
FOLDERS = 256


def merged(both: DataFrame, *more: str) -> DataFrame:
    """The parts of one family as one; ``more``: columns that follow from its keys."""
    return both.groupBy(*more, *KEYS).agg(
        F.sum("family_size").alias("family_size"), F.sum("total").cast("decimal(28,2)").alias("total"), F.max("has_original").alias("has_original"), F.min("earliest").alias("earliest"), F.min("first").alias("first"),
    )


def finished(stored: DataFrame) -> DataFrame:
    """Parts as ``families.rollup`` gives families."""
    rep = (F.col(f"first.row.{c}").alias(f"rep_{c}") for c in REP)
    return stored.select(*KEYS, "family_size", F.col("total").cast("double").alias("total"), "has_original", "earliest", *rep)


def singles(rows: DataFrame, name_counts: bool = True) -> DataFrame:
    """Each row as the part of a family that has no other."""
    return rows.select(
        *KEYS, F.lit(1).cast("long").alias("family_size"), F.col("amount").cast("decimal(18,2)").cast("decimal(28,2)").alias("total"),
        is_original(F.col("amendment"), name_counts).cast("int").alias("has_original"), F.col("award_date").alias("earliest"),
        F.struct(member_order(name_counts).alias("order"), F.struct(*REP).alias("row")).alias("first"),
    )


def refresh(rows: DataFrame, path: str, load: int, name_counts: bool = True, folders: int = FOLDERS) -> list[int]:
    """Bring a stored roll-up up to date with the new rows of a load; loads have rising numbers. ``folders`` is the same
    for all loads of a roll-up. The folders that were overwritten are returned.

    New rows and the stored parts of their folders move once, to the pieces of folders in which they are merged and
    written. What is written lies aside until all of it is there, and takes the folders' place then."""
    spark, many = rows.sparkSession, many_parts(rows)
    hashed = F.xxhash64(*KEYS)
    folder = lambda h: F.pmod(h, F.lit(folders)).cast("int")
    touched = {r["folder"] for r in rows.select(folder(hashed).alias("folder")).distinct().collect()}  # a number for each folder
    both = singles(rows, name_counts)
    if exists(spark, path):
        old = spark.read.parquet(path).where(F.col("folder").isin(touched))
        touched -= {r["folder"] for r in old.groupBy("folder").agg(F.max("load").alias("load")).where(F.col("load") >= load).collect()}
        both = both.unionByName(old.where(F.col("folder").isin(touched)).drop("load", "folder"))
    if touched:
        each = -(-(many or 1) // folders)  # pieces of a folder
        both = both.withColumn("piece", F.pmod(hashed, F.lit(folders * each))).where(folder(F.col("piece")).isin(touched))
        fresh = merged(both.repartition(folders * each, "piece"), "piece").withColumns({"load": F.lit(load), "folder": folder(F.col("piece"))}).drop("piece")
        fresh.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy("folder").parquet(path)
        if many:
            release(spark)  # the shuffle files of a large load
    return sorted(touched)


def families(spark, path: str) -> DataFrame:
    """The stored families."""
    return finished(spark.read.parquet(path))
