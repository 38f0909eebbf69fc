"""The corpus pipeline: stages over ``documents`` that each work on all that the one before it kept.

1. language ID: documents that the classifier rejects go;
2. line dedup: later occurrences of three-line windows are cut out of the texts;
3. n-gram Jaccard join: of each group of near duplicates (five words, 80 percent) the document with the
   smallest doc_id stays, a null one being larger than every other;
4. mixing: documents are repeated or left out, so that sources come near their target weights;
5. BPE: every remaining document is encoded and decoded.

Each stage takes (spark, docs, sf_dir); ``docs`` and all results but the last have the columns of
``documents``. Nulls, ties and repeated rows are treated as the operators' modules say. The near-duplicate and
mixing stages tell rows apart by keys of their own, so null and shared doc_ids are treated like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard, langid, lines, mixing
from ledgerloom.llm.chunks import WORD_CLASS
from ledgerloom.session import checkpoint_dir, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    docs = docs.select(*COLUMNS)
    return langid.predict(docs, langid.fit(docs)).where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; n_chars follows the text."""
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; rows without words are in no group and all stay. Rows are told apart by
    a hash of doc_id and text. Of rows with both in common the first by lang, source and n_chars stays."""
    docs = docs.select(*COLUMNS)
    worded = F.coalesce(F.col("text").rlike(WORD_CLASS), F.lit(False))
    rows = docs.where(worded).withColumn("__key", F.xxhash64("doc_id", "text"))
    found = jaccard.near_components(rows.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id").checkpoint()
    member = found.distinct().join(rows.select("__key", "doc_id").distinct(), "__key")
    first = member.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "__key")).alias("first"))
    gone = member.join(first, "component_id").where("__key <> first.__key").select("__key")
    repeated = found.groupBy("__key").count().where("count > 1").select("__key")
    rows = rows.join(gone, "__key", "left_anti")
    place = F.row_number().over(Window.partitionBy("__key").orderBy("lang", "source", "n_chars"))
    once = rows.join(repeated, "__key", "left_semi").withColumn("__place", place).where("__place = 1")
    return docs.where(~worded).unionByName(rows.join(repeated, "__key", "left_anti").select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Rows are numbered once, in a checkpoint; their random numbers follow from
    doc_id and text."""
    checkpoint_dir(spark)
    docs = docs.select(*COLUMNS).withColumn("__key", F.monotonically_increasing_id()).checkpoint()
    sized = mixing.with_sizes(docs.withColumn("doc_id", F.xxhash64("doc_id", "text")), "__key")
    copies = mixing.mix_sources(sized, key="__key").where("copies > 0").select("__key", "copies")
    return docs.join(copies, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, as digests."""
    return bpe.digests(bpe.bpe_round_trip(docs, bpe.vocabulary_path()))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]
#: The classifier cannot be expressed in SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
    return docs
