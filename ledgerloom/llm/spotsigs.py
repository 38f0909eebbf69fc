"""Operator 1: SpotSigs fingerprints, with DataFrame functions only.

A spot signature is a common word (an anchor) with the chain of the next ``CHAIN`` content words after
it; other common words between them are skipped. A text's fingerprint is the set of its signatures,
hashed to 64 bits, sorted and written in hexadecimal. Two fingerprints are compared by the Jaccard
likeness of their sets. The likeness cannot be over the ratio of the set sizes, so in a search for near
duplicates sets are partitioned by length, only partitions within reach meet, and a set's signatures
beyond the prefix that any partner must share are not looked up.

Defined results: null text is empty; a text without a complete chain has one signature, its whole
sequence of words; a text without words has the empty fingerprint, which is like another empty one (1.0)
and unlike all others (0.0). In the order of documents a null doc_id comes last, and rows of one doc_id
follow a hash of their text; exact repeats of a row count as one document in that order and are each
returned. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir

from .chunks import NULL_ID, plain_id

CHAIN = 3
# Anchors, and other common words that chains skip, of English, German, French and Spanish.
ANCHORS = "a an the is was are that with for der die das ist ein eine und le la les un une est que el los las una es para por"
SKIPPED = "of to in on by as at or and be it he his had this not zu den dem des von mit auf et de du des en dans pour sur se y o al con su"
MARK = "\u0001"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text, as longs."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "), F.lit(" "))
    skip, anchor = (f" (?:{'|'.join(dict.fromkeys(w.split()))})(?= )" for w in (SKIPPED, ANCHORS))
    marked = F.regexp_replace(F.regexp_replace(words, skip, ""), anchor, MARK)
    chains = F.regexp_extract_all(marked, F.lit(f"{MARK}(?=((?:{MARK}* [^ {MARK}]+){{{chain}}}))"), F.lit(1))
    found = F.array_sort(F.array_distinct(F.transform(chains, lambda c: F.xxhash64(F.translate(c, MARK, "")))))
    bare = F.trim(words)
    return F.when(F.size(found) > 0, found).when(bare != "", F.array(F.xxhash64(bare))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(sigs: Column) -> Column:
    """The signatures as text."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s), 16, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(both / union)


def near_duplicates(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(left, right, likeness) of distinct fingerprints at least ``threshold`` alike, from rows (fp, sigs) with
    distinct non-empty ``sigs``. Lengths are cut into partitions that grow by 1 / threshold, so partners lie in
    one partition or neighbours; a set of n signatures is looked up by its n - ceil(threshold * n) + 1 least."""
    n = F.size("sigs")
    part = F.floor(F.log(n.cast("double")) / math.log(1 / threshold)).cast("int")
    rows = prints.where(n > 0).withColumns({"n": n, "part": part})
    prefix = rows.select("fp", "n", "part", F.explode(F.slice("sigs", 1, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)).alias("sig"))
    left = prefix.select(F.col("fp").alias("left"), F.col("n").alias("n1"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("fp").alias("right"), F.col("n").alias("n2"), "sig", "part")
    shorter = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("left") < F.col("right")))
    pairs = left.join(right, ["sig", "part"]).where(shorter & (F.col("n1") >= F.col("n2") * threshold - 1e-9)).select("left", "right").distinct()
    a, b = (prints.select(F.col("fp").alias(x), F.col("sigs").alias(f"{x}_sigs")) for x in ("left", "right"))
    found = pairs.join(a, "left").join(b, "right").select("left", "right", likeness(F.col("left_sigs"), F.col("right_sigs")).alias("likeness"))
    return found.where(F.col("likeness") >= threshold - 1e-9)


def next_document(ids: DataFrame) -> DataFrame:
    """(id, h, n, next_id, next_h) of distinct (id, h): the one that follows, after the last the first.
    Rows are dealt by range; only the first row of each range crosses to the one before."""
    checkpoint_dir(ids.sparkSession)
    ids = ids.groupBy("id", "h").agg(F.first("n").alias("n"))
    ids = ids.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id()).checkpoint()
    at = F.lead(F.struct("id", "h")).over(Window.partitionBy("part").orderBy("id", "h"))
    heads = ids.groupBy("part").agg(F.min(F.struct("id", "h")).alias("head"))  # a row for each partition
    order = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    return ids.withColumn("at", at).join(F.broadcast(heads), "part").select("id", "h", "n", F.coalesce("at", "head").alias("to")).select("id", "h", "n", F.col("to.id").alias("next_id"), F.col("to.h").alias("next_h"))


def edited_fingerprints(docs: DataFrame, share: int = 4) -> DataFrame:
    """(doc_id, n_chars, edited, sigs, edited_sigs, next_sigs): each text, and the text whose last 1 / ``share``
    is replaced by the start of the next document."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    ring = next_document(base.select("id", "h", F.length("text").alias("n")))
    printed = base.withColumn("sigs", signatures(F.col("text")))
    asked = ring.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("to_id"), F.col("h").alias("to_h"), F.col("n").alias("to_n"))
    given = printed.join(asked, ["id", "h"]).select("to_id", "to_h", F.substr("text", F.lit(1), F.floor(F.col("to_n") / share).cast("int")).alias("start"), F.col("sigs").alias("next_sigs"))
    given = given.groupBy("to_id", "to_h").agg(F.first("start").alias("start"), F.first("next_sigs").alias("next_sigs"))
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / share).cast("int")), "start")
    got = printed.join(given, (F.col("id") == F.col("to_id")) & (F.col("h") == F.col("to_h"))).select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    return got.select(plain_id("id").alias("doc_id"), "n_chars", "edited", "sigs", signatures(F.col("edited")).alias("edited_sigs"), "next_sigs")


def op1_spotsigs(spark, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their next documents."""
    got = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
