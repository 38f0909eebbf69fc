"""Operator 6: mixing sources to target weights by Pareto order sampling.

Sources share a number of words by weight, up to a limit for each (``source_targets``). A source whose
target is t times its own words takes floor(t) whole copies of every document for certain. For the
rest it draws a sample of unequal probabilities: with f the fraction still wanted, a document's
inclusion odds are f / (1 - f) times (size / mean size) ** 0.5, and documents are ranked by their
random odds divided by their inclusion odds (Pareto order sampling). They are taken in that order until
the wanted words are reached, so the sample has the fixed size in words, to within half a document.

The running sum over a source's ranking is never made in one task: words are summed in 256 intervals
of the rank, then in 256 parts of the interval in which the target falls, and only the rows of that
part are ordered. The random number is a hash of doc_id and seed, so reruns agree.

Defined results: null text has size 0; null is a source of its own, after all others; documents of
size 0 take 0 words; an empty table gives no rows; rows that share a doc_id share its random number, and
exact repeats count one after another; of other columns only the key that the caller names is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir

PARTS = 256
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 10_000


def with_sizes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size in words and the columns ``more`` of each document."""
    return docs.select("doc_id", "source", *more, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: int = 2) -> DataFrame:
    """(source, source_size, n_docs, target): ``share`` of all sizes dealt by the repeating weights, at
    most ``limit`` times a source's size. With sources in the order of limit / weight, the level is the
    largest quotient (what is left) / (weights left) that its own source can hold."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    by = by.withColumn("w", F.get(F.array(*map(F.lit, weights)), rank)).withColumn("cap", F.col("source_size") * limit)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (total - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    return by.select("source", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what their source has; null is equal to null."""
    side = sources.withColumnRenamed("source", "__source")
    if sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return rows.join(side, rows["source"].eqNullSafe(side["__source"]), "left").drop("__source")


def mix_sources(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = 17, size_power: float = 0.5, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each row of ``sized``; also ``key``, a column that tells
    its rows apart, if one is named."""
    keys = [key] if key else []
    checkpoint_dir(sized.sparkSession)
    sized = sized.select(*keys, "doc_id", "source", "size").checkpoint()
    targets = source_targets(sized, weights, share, limit).checkpoint()
    rows = by_source(sized, targets)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    f = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}"))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    scale = F.sqrt(F.col("size") * F.col("n_docs") / F.col("source_size")) if size_power == 0.5 else F.pow(F.col("size") * F.col("n_docs") / F.col("source_size"), F.lit(size_power))
    wanted = (F.col("size") > 0) & (F.col("rest") > 0)
    q = (u / (1 - u)) / (f / (1 - f) * scale)
    rows = rows.withColumn("v", F.when(wanted, q / (1 + q)))
    rows = rows.withColumn("a", F.floor(F.col("v") * PARTS)).withColumn("b", F.floor(F.col("v") * PARTS * PARTS) % PARTS)

    def edge(part: DataFrame, digit: str, start) -> DataFrame:
        """For each source, the interval in which its target falls, and the words before that interval."""
        sums = part.groupBy("source", digit).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first(start).alias("start"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("start")
        found = sums.withColumn("before", before).where(F.col("before") <= F.col("rest"))
        return found.groupBy("source").agg(F.max(digit).alias(f"edge_{digit}"), F.max("before").alias(f"before_{digit}"))

    drawn = rows.where("v is not null")
    first = edge(drawn, "a", F.lit(0)).checkpoint()
    rows = by_source(rows, first)
    second = edge(rows.where("a = edge_a"), "b", F.col("before_a")).checkpoint()
    rows = by_source(rows, second)
    last = (F.col("a") == F.col("edge_a")) & (F.col("b") == F.col("edge_b"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("v", "doc_id", *keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before_b")
    keep = [*keys, "doc_id", "source", "size", "source_size", "target"]
    near = rows.where(last).withColumn("more", (inside + F.col("size") / 2 <= F.col("rest")).cast("int"))
    far = rows.where(~F.coalesce(last, F.lit(False))).withColumn("more", F.coalesce((F.col("a") < F.col("edge_a")) | ((F.col("a") == F.col("edge_a")) & (F.col("b") < F.col("edge_b"))), F.lit(False)).cast("int"))
    return far.unionByName(near).select(*keep, (F.col("whole") + F.col("more")).cast("int").alias("copies"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to the weights 3, 1, 2."""
    got = mix_sources(with_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
  [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, n_docs, least(CAST(source_size * 2 AS DOUBLE),
    (max(level) FILTER (WHERE level <= source_size * 2 / w) OVER ()) * w) AS target FROM l),
r AS (SELECT d.*, source_size, n_docs, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
f AS (SELECT *, target - whole * source_size AS rest,
  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#17'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM r),
q AS (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN
  (u / (1 - u)) / ((rest / source_size) / (1 - rest / source_size) * sqrt(size * n_docs / source_size)) END AS q FROM f),
c AS (SELECT *, coalesce(sum(size) FILTER (WHERE q IS NOT NULL) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN q IS NOT NULL AND before + size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""
