"""Operator 11: ranked lexical search, with bags of terms scored once for all documents that share them.

1. The vocabulary is that of the items; texts are cut into terms and restricted to it. A document becomes its number
   of terms n and its vector of (term, tf), both counted over its whole text.
2. From all documents: N, L, and df of each term of the vocabulary; from n, N and L a document's m.
3. Documents with the same vector and the same m have the same score for every item. Such a class is found by hash,
   told from others by comparison of the vectors themselves, and keeps the k smallest of its members' doc_ids: no
   result holds more of one class.
4. Tasks score classes, not documents, against all items at once; a task hands on the best k classes of each item with
   their members, which hold its best k documents; a window over what tasks hand on gives the ranks.

Items are the stated queries. They are dealt into slices of bounded size (``SLICE_ITEMS``, ``SLICE_BYTES``), one pass
over the documents each, so what tasks hold of them is bounded however many there are.

Defined results: a null text has no term and is not counted in N; null doc_ids come after all others among equal
scores; rows that share a doc_id are documents of their own; items that share an item_id are ranked each for itself;
items without terms, or in an empty corpus, get no rows; other columns of both tables are not read. Weights and scores
are 64-bit integers. Texts are taken whole, in batches of bounded bytes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import written

from .chunks import NULL_ID, plain_id, text_buffer
from .terms import Lookup, runs

# What is no part of a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The parts of the formulas of weights and scores.
WEIGHT_SCALE, LENGTH_SHARE, TF_SCALE, SCORE_SCALE, LENGTH_SCALE = 1000, 25, 1000, 1_000_000_000, 12
TOP = 20
#: Bounds of a slice of the items, and entries (document, term) that a task scores at once.
SLICE_ITEMS, SLICE_BYTES, ENTRIES = 512, 256 << 10, 16_384
_INSIDE = np.ones(256, bool)
_INSIDE[[b for b in range(128) if not re.fullmatch(TERM, chr(b))]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CAPITALS = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_ENTRY = np.dtype([("term", "<i4"), ("tf", "<i4")])


def terms_of(text: str | None) -> list[str]:
    return re.findall(TERM, (text or "").translate(_CAPITALS))


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(ids, n, rows, bag): documents of one batch with equal n and bag in one row, with the ``TOP`` smallest of their
    ids and their number. ``bag`` has (term, tf) of the vocabulary by ascending term."""
    width = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(vocabulary)
        for batch in batches:
            ids, (data, offsets) = np.asarray(batch.column(0)), text_buffer(batch.column(1))
            count, number, keys = np.zeros(len(ids), np.int64), [], []
            data = _LOWER[data]
            step = np.searchsorted(offsets, np.arange(0, offsets[-1] + 1, 4 << 20))
            for lo, hi in zip(step, [*step[1:], len(ids)], strict=True):  # some MB of text at a time
                if hi > lo:
                    text = data[offsets[lo] : offsets[hi]]
                    part = runs(text, offsets[lo : hi + 1] - offsets[lo], _INSIDE)
                    count[lo:hi] = np.bincount(part.doc, minlength=hi - lo)
                    term = known.find(text, part.start, part.end)
                    hit = term >= 0
                    key, tf = np.unique((part.doc[hit] + lo) * width + term[hit], return_counts=True)
                    keys.append(key)
                    number.append(tf)
            key, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, number))
            entry = np.empty(len(key), _ENTRY)
            entry["term"], entry["tf"] = key % width, tf
            bound = np.searchsorted(key // width, np.arange(len(ids) + 1)) * _ENTRY.itemsize
            raw, groups = entry.tobytes(), {}
            for i in np.argsort(ids, kind="stable").tolist():
                groups.setdefault((int(count[i]), raw[bound[i] : bound[i + 1]]), []).append(int(ids[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[:TOP] for x in groups.values()], pa.list_(pa.int64())), pa.array([n for n, _ in groups], pa.int64()), pa.array([len(x) for x in groups.values()], pa.int64()), pa.array([b for _, b in groups], pa.binary())],
                ["ids", "n", "rows", "bag"],
            )

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "ids array<long>, n long, rows long, bag binary")


def document_counts(table: DataFrame) -> DataFrame:
    """(term, df) over all documents: each task counts its own, then the counts are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            entry = np.frombuffer(b"".join(batch.column(1).to_pylist()), _ENTRY)
            size = np.array([len(b) // _ENTRY.itemsize for b in batch.column(1).to_pylist()], np.int64)
            df = np.bincount(entry["term"], np.repeat(np.asarray(batch.column(0)), size)) if len(entry) else np.zeros(0)
            total.update({int(t): int(df[t]) for t in np.flatnonzero(df)})
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["term", "df"])

    return table.select("rows", "bag").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def classes(table: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """(m, bag, ids): each class of documents with the k smallest of its ids. Tasks keep k rows of a class before the
    shuffle, so a class of very many documents sends few."""
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {documents}L) div {terms}L")
    rows = table.where("octet_length(bag) > 0").select(m.alias("m"), "bag", F.explode("ids").alias("id")).withColumn("h", F.xxhash64("bag", "m"))
    key = ["h", "m", "bag"]
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("place") <= k)
    return first.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids")).select("m", "bag", "ids")


def scored(table: DataFrame, weights: np.ndarray, items: int, k: int) -> DataFrame:
    """(item, doc_id, score): from each task the best k documents of each item. ``weights``: what one occurrence of a
    term counts for each item, by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(items, np.int64)  # a score below cannot be among the best k any more
        members: list[list[int]] = []
        pool = [np.zeros(0, np.int64)] * 4  # item, score, smallest id, class

        def prune() -> None:
            item, score, first, _ = pool
            order = np.lexsort((first, -score, item))
            place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            kept = order[place < k]
            last = order[place == k - 1]
            least[item[last]] = score[last]
            used, back = np.unique(pool[3][kept], return_inverse=True)
            members[:] = [members[i] for i in used.tolist()]
            pool[:] = [item[kept], score[kept], first[kept], back]

        for batch in batches:
            m, raw, ids = np.asarray(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            size = np.array([len(b) // _ENTRY.itemsize for b in raw], np.int64)
            entry = np.frombuffer(b"".join(raw), _ENTRY)
            tf = entry["tf"].astype(np.int64)
            part = SCORE_SCALE * tf // (TF_SCALE * tf + LENGTH_SCALE * np.repeat(m, size))
            end, lo = np.cumsum(size), 0
            while lo < len(m):
                at = end[lo] - size[lo]
                hi = max(lo + 1, int(np.searchsorted(end, at + ENTRIES, side="right")))
                each = weights[entry["term"][at : end[hi - 1]]] * part[at : end[hi - 1], None]
                score = np.add.reduceat(each, end[lo:hi] - size[lo:hi] - at, axis=0)  # every class has an entry
                doc, item = np.nonzero(score >= least)
                used, back = np.unique(doc, return_inverse=True)
                base = len(members)
                members += [ids[lo + i] for i in used.tolist()]
                first = np.array([members[base + i][0] for i in range(len(used))], np.int64)
                new = item, score[doc, item], first[back] if len(used) else np.zeros(0, np.int64), base + back
                pool[:] = [np.append(a, b) for a, b in zip(pool, new, strict=True)]
                if len(pool[0]) > 4 * k * items:
                    prune()
                lo = hi
        prune()
        size = np.array([len(members[c]) for c in pool[3].tolist()], np.int64)
        doc = np.array([i for c in pool[3].tolist() for i in members[c]], np.int64)
        item, score = np.repeat(pool[0], size), np.repeat(pool[1], size)
        order = np.lexsort((doc, -score, item))
        best = order[np.arange(len(order)) - np.searchsorted(item[order], item[order]) < k]
        yield pa.RecordBatch.from_arrays([pa.array(item[best].astype(np.int32)), pa.array(doc[best]), pa.array(score[best])], ["item", "doc_id", "score"])

    return table.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of highest score above 0, equal ones by id."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    slices = max(1, -(-size["n"] // SLICE_ITEMS), -(-size["bytes"] // SLICE_BYTES))
    parts = [ranked_slice(docs, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s), k) for s in range(slices)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ranked_slice(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The same for items of a bounded number and size, which the driver gives to tasks."""
    given = [(r["item_id"], Counter(terms_of(r["text"]))) for r in items.collect()]
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for _, bag in given for t in bag}))}
    none = items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not vocabulary:
        return none
    table = written(bags(docs, vocabulary), "bags")
    facts = table.where("n > 0").agg(F.sum("rows").alias("documents"), F.sum(F.col("n") * F.col("rows")).alias("terms")).first()
    if not facts["documents"]:
        return none
    df = {r["term"]: r["df"] for r in document_counts(table).collect()}  # a row for each term of the slice at most
    weight = [math.floor(WEIGHT_SCALE * math.log((2 * facts["documents"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
    weights = np.zeros((len(vocabulary), len(given)), np.int64)
    for i, (_, bag) in enumerate(given):
        for t, n in bag.items():
            weights[vocabulary[t.encode()], i] = n * weight[vocabulary[t.encode()]]
    found = scored(classes(table, facts["documents"], facts["terms"], k), weights, len(given), k)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    names = F.array(*(F.lit(i).cast("long") for i, _ in given))
    return best.select(F.get(names, F.col("item")).alias("item_id"), "rank", plain_id().alias("doc_id"), "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ranked(table("documents"), table("benchmark"))


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{TERM}') AS terms FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM c),
q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor({WEIGHT_SCALE} * ln((2 * (SELECT docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
m AS (SELECT doc_id, {100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * (SELECT docs FROM s)) // (SELECT total FROM s) AS m FROM c),
r AS (SELECT item_id, doc_id, CAST(sum(reps * w * (({SCORE_SCALE} * tf) // ({TF_SCALE} * tf + {LENGTH_SCALE} * m))) AS BIGINT) AS score
  FROM p JOIN m USING (doc_id) JOIN w USING (term) JOIN q USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {TOP}"""
