"""Dashboard figures: top contractors and entities, years, table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.parse import money


def archived(families: DataFrame, years: tuple[str, ...] = ()) -> DataFrame:
    """The families whose representative row is of one of the archived years; all if none are named. Families are made
    of the rows of all years first."""
    return families.where(F.col("rep_fiscal_year").isin(*years)) if years else families


def top_contractors(families: DataFrame, n: int = 5, years: tuple[str, ...] = ()) -> DataFrame:
    got = archived(families, years).where("family <> ''").groupBy("family").agg(F.max("rep_contractor").alias("contractor"), F.count("*").alias("families"), money(F.col("total")).alias("money"))
    return got.orderBy(F.desc("money"), F.desc("families"), "family").limit(n)


def top_entities(families: DataFrame, n: int = 5, years: tuple[str, ...] = ()) -> DataFrame:
    got = archived(families, years).where("trim(entity) <> ''").groupBy("entity").agg(F.count("*").alias("families"), money(F.col("total")).alias("money"))
    return got.orderBy(F.desc("money"), F.desc("families"), "entity").limit(n)


def by_year(families: DataFrame, years: tuple[str, ...] = ()) -> DataFrame:
    got = archived(families, years).where("trim(rep_fiscal_year) <> ''")
    return got.groupBy(F.col("rep_fiscal_year").alias("fiscal_year")).agg(F.count("*").alias("families"), money(F.col("total")).alias("money"))


def share_of_largest(ranked: DataFrame) -> DataFrame:
    """Each amount as a share of the largest; for ranked lists of a few rows."""
    return ranked.withColumn("share", F.col("money") / F.max("money").over(Window.partitionBy()))


def table_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), money(F.col("amount")).alias("money"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))


def rows_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n_rows"), money(F.col("amount")).alias("money"))
