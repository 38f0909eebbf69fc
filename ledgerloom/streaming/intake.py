"""Incremental intake of new records with Structured Streaming.

Files of search results are read once each; the checkpoint is the cursor and moves only when a batch has succeeded.
In each batch records are enriched from the detail pages that are known (a record without a page stays as it is), told
apart by the hash of what is stored, and those that the store lacks are loaded (``operators.store``). A load's key is
that of the stream and its batch, its number goes on from the loads before, so a new checkpoint on an old store is
logged like any other run, and a batch that is run again after a failure logs what it really added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import store
from ledgerloom.operators.loading import digest
from ledgerloom.operators.resolution import enriched
from ledgerloom.sources.contracts import RECORD
from ledgerloom.sources.live import SEARCH_PAGE, detail_records, held, search_records


def intake(spark: SparkSession, folder: str, schema: StructType | str, path: str, state: str, checkpoint: str, key: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Read new JSON files, keep records whose hash the store lacks, add them and the load's state. ``prepare`` makes
    records of the rows read; records with a row_hash of their own keep it, others get one of the columns ``key``."""

    def batch(df: DataFrame, number: int) -> None:
        rows = prepare(df) if prepare else df
        if "row_hash" not in rows.columns:
            rows = rows.withColumn("row_hash", F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)), 256), 1, 16))
        stream = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # the same as long as the checkpoint is
        store.load(rows, path, state, f"{stream} {number}", order=tuple(key))

    query = spark.readStream.schema(schema).option("multiLine", True).json(folder) if isinstance(schema, str) else spark.readStream.schema(schema).json(folder)
    query.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def monitor_records(pages: DataFrame, details: DataFrame | None, base_url: str) -> DataFrame:
    """Records of search-result pages, each filled from its detail page (url, html) where there is one: the page's record
    comes first and takes what it lacks from the search record."""
    rows = pages.select(F.explode("data").alias("row")).select("row.*")
    found = search_records(rows, base_url, "live_monitor")
    if details is None:
        return found.select(*RECORD, "row_hash")
    page = detail_records(details, "live_monitor").select("source_url", F.struct(*RECORD).alias("page")).dropDuplicates(["source_url"])
    both = found.select(F.struct(*RECORD).alias("search"), "source_url", "row_hash").join(page, "source_url", "left")
    filled = enriched(held(both.where("page is not null").select("page.*", "search")), "search", "live_monitor").select(*RECORD, "row_hash")
    return filled.unionByName(held(both.where("page is null").select("search", "row_hash")).select("search.*", "row_hash"))


def monitor(spark: SparkSession, folder: str, path: str, state: str, checkpoint: str, base_url: str, details: DataFrame | None = None) -> None:
    """Intake of search-result files as canonical records."""
    intake(spark, folder, SEARCH_PAGE, path, state, checkpoint, ["contract_number", "source_contract_id"], lambda df: monitor_records(df, details, base_url))


def run_digest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """What a message about the new records of a load lists."""
    rows = store.stored(spark, path).where(F.col("load") == key)
    return digest(rows.withColumn("id", F.monotonically_increasing_id()))
