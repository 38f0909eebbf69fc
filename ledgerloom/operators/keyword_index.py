"""An inverted index of the words of contracts: a table of postings (word, id), so that a keyword query reads the few
files and row groups that hold its prefixes, and not every row's texts.

Postings lie in folders by the word's first sign, sorted by word and id inside each file; a prefix then is an equality
on the folder and a range of the sorted words, which Parquet's statistics prune. A load appends its own files, so the
index follows the table; ``compact`` merges them again. A word that very many rows share is only many short rows,
dealt by (word, id), and no list of ids is ever built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import search
from ledgerloom.session import many_parts
from ledgerloom.sources.contracts import exists


def pairs(rows: DataFrame) -> DataFrame:
    """(word, id): each distinct word of each row."""
    return rows.select(F.explode(F.array_distinct(search.words())).alias("word"), "id")


def with_first(each: DataFrame) -> DataFrame:
    return each.select(F.substring("word", 1, 1).alias("first"), "word", "id")


def postings(rows: DataFrame) -> DataFrame:
    """(first, word, id): each distinct word of each row."""
    return with_first(pairs(rows))


def ranged(each: DataFrame, parts: int | None) -> DataFrame:
    """(word, id) dealt by ranges, ``parts`` of them or the session's number."""
    return each.repartitionByRange(*([parts] if parts else []), "word", "id")


def add(rows: DataFrame, path: str) -> None:
    """Index more rows (those of a load). They are read twice, for the ranges and to be laid out: rows that are costly to
    make are better given as a table."""
    sorted_ = with_first(ranged(pairs(rows), many_parts(rows))).sortWithinPartitions("first", "word", "id")
    sorted_.write.mode("append").partitionBy("first").parquet(path)


def compact(spark: SparkSession, path: str) -> None:
    """Merge the files of several loads into one sorted run; rows indexed twice are kept once. Equal rows lie in one range,
    so the rows move once. What is written lies aside until all of it is there, and takes the folders' place then."""
    table = spark.read.parquet(path)
    once = with_first(ranged(table.select("word", "id"), many_parts(table)).distinct())
    once.sortWithinPartitions("first", "word", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("first").parquet(path)


def hits(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The ids of the rows in which each word of the query begins some word."""
    given = sorted(set(search.tokens(query)))
    # a prefix of another one is implied by it
    given = [t for t in given if not any(o != t and o.startswith(t) for o in given)]
    if not given or not exists(spark, path):
        return spark.createDataFrame([], "id long")
    table = spark.read.parquet(path).select(F.col("first").cast("string").alias("first"), "word", "id")
    one = lambda t: table.where((F.col("first") == t[0]) & F.startswith("word", F.lit(t))).select("id").distinct()
    if len(given) == 1:
        return one(given[0])
    each = reduce(DataFrame.unionAll, map(one, given))
    return each.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(given)).select("id")


def keyword(rows: DataFrame, path: str, query: str) -> DataFrame:
    """Rows by word beginnings, found through the index of their whole table; by parts of words if the index has none.
    Whether it has any is asked first, so that only one of the two ways is planned."""
    if not search.tokens(query):
        return rows
    found = hits(rows.sparkSession, path, query)
    return rows.where(search.keyword_part(query)) if found.isEmpty() else rows.join(found, "id", "left_semi")
