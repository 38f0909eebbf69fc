"""Operator 3: exact removal of repeated word windows, found through difference-cover anchors.

A window of ``width`` words is removed from a document when the same words also start somewhere in a
document with a smaller doc_id. Hashing every window of the corpus would move several times the
input. Positions modulo a period v that lie in a difference cover D hold for any two positions i, j
an offset d < v with i + d and j + d both in D. Hence two equal windows share an anchor of
width - v + 1 words that starts at a cover position of both documents. So

1. each chunk hashes its anchors (six positions of 31 for 50 words) and the buckets say which occur
   more than once;
2. repeated anchors are extended to all windows that hold them; only those windows are hashed whole,
   with the smallest doc_id of each chunk, and the buckets say which also start in a smaller document;
3. each chunk covers its words with those windows and returns what is left.

Defined results: null text has no words; documents under ``width`` words keep all; a null doc_id is
larger than every other and comes back null; rows of one doc_id never remove each other's words;
repeated rows give one row each; other columns are not read. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C

# Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
ANSWER = "chunk int, bucket int, kind int, answer binary"


def period_for(width: int) -> int:
    """The longest period that leaves anchors of at least two fifths of the window."""
    return max(v for v in COVERS if width - v + 1 >= max(1, 0.4 * width) or v == 1)


def anchors_of(words: C.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each anchor."""
    period = period_for(width)
    on = np.zeros(period, bool)
    on[list(COVERS[period])] = True
    h, start = C.windows_of(words, width - period + 1)
    keep = on[(start - words.first[words.doc[start]]) % period]
    return h[keep], start[keep]


def short_values(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits after those that name the bucket."""
    return ((sorted_hashes << np.uint64(buckets.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)


def blocks(chunk: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """The distinct hashes of a chunk, one block for each bucket."""
    u = np.sort(hashes)
    u = u[np.append(True, u[1:] != u[:-1])] if len(u) else u
    have, bounds = C.deal(C.bucket_of(u, buckets), buckets)
    return pa.table({"chunk": pa.array(np.full(len(have), chunk, np.int32)), "bucket": pa.array(have.astype(np.int32)), "block": pa.array(C.blobs(short_values(u, buckets), bounds), pa.binary())})


def shared(table: pa.Table) -> pa.Table:
    """For each block of a bucket, a bit for each value: whether another chunk has it too."""
    got = C.arrays(table["block"], np.uint32)
    _, inverse, count = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
    many, at, out = count[inverse] > 1, 0, []
    for x in got:
        out.append(np.packbits(many[at : at + len(x)]).tobytes())
        at += len(x)
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "kind": pa.array(np.ones(len(out), np.int32)), "answer": pa.array(out, pa.binary())})


def repeated(hashes: np.ndarray, buckets: int, given: dict[int, bytes]) -> np.ndarray:
    """Which hashes of a chunk occur again, in it or in others (``given``: the answers by bucket)."""
    u, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    have, bounds = C.deal(C.bucket_of(u, buckets), buckets)
    return (C.unpack([given[int(b)] for b in have], np.diff(bounds)) | (count > 1))[inverse] if len(u) else np.zeros(0, bool)


def candidates(words: C.Words, width: int, buckets: int, given: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window that holds a repeated anchor."""
    h, start = anchors_of(words, width)
    at = start[repeated(h, buckets, given)]
    step = np.zeros(len(words.hash) + 2, np.int32)
    np.add.at(step, np.maximum(at - (period_for(width) - 1), words.first[words.doc[at]]), 1)
    np.add.at(step, at + 1, -1)
    h, start = C.windows_of(words, width)
    keep = np.cumsum(step)[start] > 0
    return h[keep], start[keep]


def least_ids(h: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a chunk with their smallest doc_id, dealt to buckets and sorted by id there:
    hashes, ids, their buckets, and for each input row its place."""
    u, inverse = np.unique(h, return_inverse=True)
    least = np.full(len(u), C.NULL_ID, np.int64)
    np.minimum.at(least, inverse, ids)
    bucket = C.bucket_of(u, buckets)
    order = np.lexsort((least, bucket))
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], least[order], bucket[order], place[inverse]


def smaller(table: pa.Table) -> pa.Table:
    """For each block, a bit for each hash: whether another chunk has it in a smaller document."""
    hashes, ids = C.arrays(table["hashes"], np.uint64), C.arrays(table["ids"], np.int64)
    all_ids = np.concatenate(ids)
    u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    least = np.full(len(u), C.NULL_ID, np.int64)
    np.minimum.at(least, inverse, all_ids)
    less, at, out = least[inverse] < all_ids, 0, []
    for x in ids:
        out.append(np.packbits(less[at : at + len(x)]).tobytes())
        at += len(x)
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "kind": pa.array(np.full(len(out), 2, np.int32)), "answer": pa.array(out, pa.binary())})


def remove_repeated_words(docs: DataFrame, width: int = 50, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each document; see the module's text."""
    plan = C.layout(docs, chunk_bytes)
    n = plan.buckets
    dealt = C.with_chunks(docs, plan.chunks)

    def send_anchors(table: pa.Table) -> pa.Table:
        return blocks(table["chunk"][0].as_py(), anchors_of(C.words_of(*C.text_buffer(table["text"])), width)[0], n)

    def send_windows(table: pa.Table, masks: pa.Table) -> pa.Table:
        words = C.words_of(*C.text_buffer(table["text"]))
        h, start = candidates(words, width, n, C.answers(masks))
        u, ids, bucket, _ = least_ids(h, table["doc_id"].to_numpy()[words.doc[start]], n)
        have, bounds = C.deal(bucket, n)
        chunk = table["chunk"][0].as_py() if len(table) else 0
        return pa.table({"chunk": pa.array(np.full(len(have), chunk, np.int32)), "bucket": pa.array(have.astype(np.int32)), "hashes": pa.array(C.blobs(u, bounds), pa.binary()), "ids": pa.array(C.blobs(ids, bounds), pa.binary())})

    def keep(table: pa.Table, masks: pa.Table) -> pa.Table:
        data, offsets = C.text_buffer(table["text"])
        words = C.words_of(data, offsets)
        doc_ids = table["doc_id"].to_numpy()
        h, start = candidates(words, width, n, C.answers(masks, 1))
        _, least, bucket, place = least_ids(h, doc_ids[words.doc[start]], n)
        have, bounds = C.deal(bucket, n)
        given = C.answers(masks, 2)
        less = C.unpack([given[int(b)] for b in have], np.diff(bounds))
        gone = start[less[place] | (doc_ids[words.doc[start]] > least[place])]
        step = np.zeros(len(words.hash) + width + 1, np.int32)
        step[gone] += 1
        step[gone + width] -= 1
        left = np.cumsum(step)[: len(words.hash)] == 0
        removed = np.bincount(words.doc[~left], minlength=len(doc_ids))
        raw, texts = data.tobytes(), []
        for d, lost in enumerate(removed.tolist()):
            own = raw[offsets[d] : offsets[d + 1]].split()
            texts.append(b" ".join(compress(own, left[words.first[d] : words.first[d + 1]].tolist()) if lost else own))
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    masks = dealt.groupBy("chunk").applyInArrow(send_anchors, "chunk int, bucket int, block binary").groupBy("bucket").applyInArrow(shared, ANSWER)
    found = dealt.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(send_windows, "chunk int, bucket int, hashes binary, ids binary").groupBy("bucket").applyInArrow(smaller, ANSWER)
    kept = dealt.groupBy("chunk").cogroup(masks.unionAll(found).groupBy("chunk")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
    return kept.withColumn("doc_id", C.plain_id())


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 50 words over all documents."""
    got = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_WORD = r"[^\x20\x09-\x0D]+"
OP3_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(words) - 48)) t(i)),
hit AS (SELECT doc_id, i FROM s JOIN (SELECT h, min(doc_id) AS first FROM s GROUP BY h) USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""
