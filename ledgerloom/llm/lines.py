"""Operator 8: line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a text are hashed (two 64-bit hashes). The first occurrence of a
window, by (doc_id, line), stays; all later ones are removed: a line goes when a later occurrence
covers it. Covered positions that touch or overlap are merged into runs and cut out of the text.

Defined results: null text is empty (one empty line); texts under three lines are kept whole; equal
windows inside one text count as later occurrences too; a null doc_id comes after all others; rows
with one doc_id are told apart by a hash of their text, and exact repeats of a row act as one document
and are each returned; a text that loses all lines becomes empty; other columns are kept as they are,
whatever their names, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import NULL_ID

ID, KEY, LINES, CUT, ROW = "__id", "__key", "__lines", "__cut", "__row"


def repeated_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(__id, __key, __cut): for each document, the sorted first lines of its later occurrences."""
    parts = F.transform(F.slice(LINES, F.lit(1), F.greatest(F.size(LINES) - (width - 1), F.lit(0))), lambda x, i: F.struct(*(F.xxhash64(F.lit(k), *(F.get(LINES, i + j) for j in range(width))).alias(f"h{k}") for k in range(2))))
    windows = docs.select(ID, KEY, F.posexplode(parts).alias("pos", "w")).select(ID, KEY, "pos", "w.h0", "w.h1")
    place = F.struct(ID, KEY, "pos")
    first = windows.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h0", "h1", "first")
    return windows.join(first, ["h0", "h1"]).where(place > F.col("first")).groupBy(ID, KEY).agg(F.sort_array(F.collect_set("pos")).alias(CUT))


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """The documents with repeated windows cut out of ``text``, plus n_lines and n_removed."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.coalesce("text", F.lit(""))
    # all columns but the text travel in one, so that none can clash with those made here
    row = F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias(ROW)
    keyed = docs.select(row, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(ID), F.xxhash64(text).alias(KEY))
    lines = keyed.select(ID, KEY, F.split(text, "\n").alias(LINES))
    cut = repeated_windows(lines, width)
    joined = keyed.join(cut, [ID, KEY], "left").withColumn(LINES, F.split(text, "\n"))
    pos = F.coalesce(F.col(CUT), F.array().cast("array<int>"))
    starts = F.filter(pos, lambda p, i: (i == 0) | (p > F.get(pos, i - 1) + width))
    stops = F.transform(F.filter(pos, lambda p, i: (i == F.size(pos) - 1) | (F.get(pos, i + 1) > p + width)), lambda p: p + width)
    # what lies between the end of one run and the start of the next
    froms, tos = F.concat(F.array(F.lit(0)), stops), F.concat(starts, F.array(F.size(LINES)))
    runs = joined.withColumns({"__from": froms, "__to": tos})
    left = F.flatten(F.transform("__from", lambda a, i: F.slice(LINES, a + 1, F.get("__to", i) - a)))
    kept = runs.withColumn("__left", F.when(F.col(CUT).isNull(), F.col(LINES)).otherwise(left))
    return kept.select(
        *(F.array_join("__left", "\n").alias("text") if c == "text" else F.col(ROW)[c].alias(c) for c in names),
        F.size(LINES).alias("n_lines"),
        (F.size(LINES) - F.size("__left")).alias("n_removed"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Three-line windows over all documents."""
    got = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d),
k AS (SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS s FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM k),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d)
SELECT e.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(c.p) AS INTEGER) AS n_removed,
  sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.p) FILTER (WHERE c.p IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY e.doc_id
"""
