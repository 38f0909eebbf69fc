"""Operator 12: hard negatives by integer inner products, several candidates in each multiplication.

Components become integers. Those of several candidates are biased to be no longer negative and laid into separate
fields of one 64-bit integer, wide enough that a field's sum never reaches the next one (Kronecker's substitution). One
multiplication for each component of an anchor, biased too, then works on all of them; fields are cut out of the sums,
and what the biases added is taken off. Scores are exact. The width follows from the largest component and the length
of the vectors, so wider values mean fewer fields, down to one.

Rows are dealt into blocks by the hash of their id, whatever their label, and anchors into slices, so a hot label or a
vector that many rows share makes no block larger. Each slice meets each block twice: first its anchors and the block's
rows of the same labels give the best positives; when those are known over all blocks, its anchors and all rows give,
for each positive, the best negatives between its bounds. A task hands on a few rows for each anchor.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors
are filled up with zeros, an empty one is all zeros; rows with the id of an anchor are not among its other rows; anchors
equal in id, label and vector are one; null ids are no anchors and come after all others among ties. Values whose scores
need more than 63 bits are refused with an error. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import NULL_ID, plain_id

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Rows of a block, anchors of a slice, anchors that a task multiplies at once.
BLOCK_ROWS, SLICE_ANCHORS, AT_ONCE = 4096, 16_384, 256


class Packing:
    """How components up to ``largest`` in size lie in 64-bit integers."""

    def __init__(self, largest: int, dim: int):
        self.bias, self.dim = largest, dim
        self.width = max(1, (dim * (2 * largest) ** 2).bit_length())
        if self.width > 63:
            raise ValueError(f"inner products need {self.width} bits")
        self.fields = 64 // self.width

    def packed(self, rows: np.ndarray) -> np.ndarray:
        """Rows (int64) as words: row i is field i % fields of word i // fields."""
        words = -(-len(rows) // self.fields)
        biased = np.zeros((words * self.fields, self.dim), np.uint64)
        biased[: len(rows)] = (rows + self.bias).astype(np.uint64)
        out = np.zeros((words, self.dim), np.uint64)
        for j in range(self.fields):
            out |= biased[j :: self.fields] << np.uint64(j * self.width)
        return out

    def scores(self, packed: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, a line for each anchor."""
        biased = (anchors + self.bias).astype(np.uint64)
        sums = biased @ packed.T
        mask = np.uint64((1 << self.width) - 1)
        fields = np.stack([(sums >> np.uint64(j * self.width)) & mask for j in range(self.fields)], axis=2)
        exact = fields.reshape(len(anchors), -1)[:, : len(rows)].astype(np.int64)
        added = self.bias * (rows.sum(axis=1) + self.dim * self.bias)
        return exact - added[None, :] - self.bias * anchors.sum(axis=1)[:, None]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, equal ones by place."""
    if len(scores) > k:
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > last)
        places = np.append(above, np.flatnonzero(scores == last)[: k - len(above)])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((places, -scores[places]))]


def integers(column, dim: int) -> np.ndarray:
    """A list column as int64 rows, filled up with zeros."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(pa.compute.list_value_length(arr))
    out = np.zeros((len(arr), dim), np.int64)
    if len(arr):
        out[np.arange(dim)[None, :] < size[:, None]] = np.asarray(arr.flatten())
    return out


def usable(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select("id", "label", F.transform("x", lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``anchor``: which rows (id, label) are
    anchors; ``label``: the label of a row of ``vectors``; ``scale``: components are multiplied by it and cut down."""
    rows = usable(vectors, F.col("label") if label is None else label, scale)
    asked = rows.where(anchor & (F.col("id") != NULL_ID)).distinct()
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: F.greatest(s, F.abs(x)))).alias("largest")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts["n"]:
        return rows.sparkSession.createDataFrame([], out)
    packing = Packing(facts["largest"], max(1, facts["dim"]))
    blocks, slices = -(-facts["n"] // BLOCK_ROWS), -(-max(1, asked.count()) // SLICE_ANCHORS)
    key = ["slice", "block"]
    deal = lambda n, name: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = rows.select(deal(blocks, "block"), each(slices, "slice"), *(F.col(c).alias(f"own_{c}") for c in ("id", "label", "v"))).groupBy(*key)
    asked = asked.withColumn("mark", F.xxhash64("label", "v"))  # with the id it tells anchors apart

    def block_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = table["own_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        return ids[order], table["own_label"].to_numpy()[order], integers(table["own_v"], packing.dim)[order]

    def products(anchors: pa.Table, chosen: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The scores of the rows for each chosen anchor."""
        packed, a = packing.packed(rows), integers(anchors["v"], packing.dim)
        for lo in range(0, len(chosen), AT_ONCE):
            part = chosen[lo : lo + AT_ONCE]
            yield from zip(part.tolist(), packing.scores(packed, rows, a[part]), strict=True)

    def same_label(anchors: pa.Table, table: pa.Table) -> pa.Table:
        ids, labels, rows = block_of(table)
        a_id, a_label = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        at, found, got = [], [], []
        for value in np.intersect1d(labels, a_label):
            mine = np.flatnonzero(labels == value)
            for i, score in products(anchors, np.flatnonzero(a_label == value), rows[mine]):
                other = np.flatnonzero(ids[mine] != a_id[i])
                top = other[best(score[other], POSITIVES)]
                at += [i] * len(top)
                found.append(ids[mine[top]])
                got.append(score[top])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        at = np.array(at, np.int64)
        return pa.table({"id": a_id[at], "mark": anchors["mark"].to_numpy()[at], "other": join(found), "score": join(got)})

    def other_labels(anchors: pa.Table, table: pa.Table) -> pa.Table:
        ids, labels, rows = block_of(table)
        a_id, a_label, known = anchors["id"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
        out = []
        if len(rows):
            for i, score in products(anchors, np.arange(len(a_id)), rows):
                other = np.flatnonzero((labels != a_label[i]) & (ids != a_id[i]))
                score = score[other]
                for p in known[i]:
                    fits = np.flatnonzero((LOW * p["score"] <= 100 * score) & (100 * score <= HIGH * p["score"]))
                    for j in fits[best(score[fits], NEGATIVES)].tolist():
                        out.append((i, p["place"], p["other"], p["score"], int(ids[other[j]]), int(score[j])))
        cols = [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table({"id": a_id[cols[0]], "mark": anchors["mark"].to_numpy()[cols[0]], "place": cols[1].astype(np.int32), "other": cols[2], "score": cols[3], "negative": cols[4], "negative_score": cols[5]})

    to_blocks = lambda df: df.select(deal(slices, "slice"), each(blocks, "block"), "*").groupBy(*key)
    positives = to_blocks(asked).cogroup(own).applyInArrow(same_label, "id long, mark long, other long, score long")
    place = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.desc("score"), "other"))
    positives = positives.withColumn("place", place).where(F.col("place") <= POSITIVES).groupBy("id", "mark").agg(F.collect_list(F.struct("place", "other", "score")).alias("positives"))
    told = asked.join(positives, ["id", "mark"])
    found = to_blocks(told).cogroup(own).applyInArrow(other_labels, "id long, mark long, place int, other long, score long, negative long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("id", "mark", "place").orderBy(F.desc("negative_score"), "negative"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select(
        F.col("id").alias("anchor_id"), plain_id("other").alias("positive_id"), "rank", plain_id("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score",
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50; labels of ids divisible by 7 are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0, label)


OP12_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank, s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
