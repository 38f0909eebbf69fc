"""Operator 13: sequences of a fixed size, filled by lexical retrieval.

1. Every text is encoded once (``wordids``) and cut into rows of at most ``size`` tokens, which lie in a table of the
   shared folder; whole rows are sequences as they are. Tasks also count in how many documents each token occurs.
2. The rest, one row of under ``size`` tokens for each document, is dealt into the shards of an inverted index by ranges
   of two min-hashes of the document's tokens, so that documents with common words lie side by side, copies too; a hash
   splits what is equal, and a task indexes at most ``SHARD_TOKENS`` at once, however many rows it has.
3. In a shard the next unused document is the seed of a sequence. The index returns the unused documents by BM25 for the
   seed's tokens (document frequencies are those of the whole corpus), and they fill the sequence in this order, the
   last one cut to the room that is left; what is cut off stays unused. Documents without a common token follow in order.
4. What is left of a task's last shard, less than one sequence, is cut into sequences of a power of two of tokens.

So no sequence needs padding: each is ``size`` tokens long or a power of two.

Defined results: a null text is empty and has the one end token; null doc_ids stay null; repeated rows and rows that
share a doc_id are documents of their own; an empty table gives no rows; other columns are not read. Texts are encoded
whole. Equal input gives equal sequences, but for rows equal in all that is read, which can be exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import written

from .bpe import vocabulary_path
from .chunks import mix, text_buffer
from .terms import ragged
from .wordids import word_ids

SIZE, END = 4096, 2
#: Tokens that one index holds; parts of a text that are encoded at once, in bytes.
SHARD_TOKENS, PART_BYTES = 2 << 20, 4 << 20
#: The parameters of BM25.
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Ranges of an array of 32-bit ids, one after another, as binary values."""
    data = np.ascontiguousarray(values, "<u4")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(data)])


def encoded(docs: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """Rows (doc_id, doc_tokens, start, ids, near, nearer) of at most ``size`` tokens of every document with its end
    token, and rows without ids (token, df) with the documents of this task that hold each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        vocabulary = max(coder.vocabulary, end + 1)
        ranks = [mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(k << 32)) >> np.uint64(33) for k in (1, 2)]
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            step = np.unique(np.append(np.searchsorted(offsets[:-1], np.arange(0, offsets[-1] + 1, PART_BYTES)), len(batch)))
            for lo, hi in zip(step[:-1].tolist(), step[1:].tolist(), strict=True):
                ids, counts = coder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                total = counts + 1
                first = np.cumsum(total) - total
                doc = np.repeat(np.arange(hi - lo), counts)
                flat = np.full(int(total.sum()), end, np.int32)
                flat[np.arange(len(ids)) + doc] = ids
                token, of, _ = counted(flat, np.repeat(np.arange(hi - lo), total))
                df += np.bincount(token, minlength=vocabulary)
                near = [np.minimum.reduceat(r[flat], first).astype(np.int64) for r in ranks]
                rows = -(-total // size)
                of = np.repeat(np.arange(hi - lo), rows)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)) * size
                none = pa.nulls(len(of), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(of)), pa.array(total[of]), pa.array(start), binary(flat, np.append(first[of] + start, len(flat))), *(pa.array(n[of]) for n in near), none, pa.nulls(len(of), pa.int64())],
                    names,
                )
        seen = np.flatnonzero(df)
        long, n = pa.nulls(len(seen), pa.int64()), len(seen)
        yield pa.RecordBatch.from_arrays([long, long, long, pa.nulls(n, pa.binary()), long, long, pa.array(seen.astype(np.int32)), pa.array(df[seen])], names)

    names = ["doc_id", "doc_tokens", "start", "ids", "near", "nearer", "token", "df"]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, doc_tokens long, start long, ids binary, near long, nearer long, token int, df long")


def counted(tokens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (token, document) in this order with their number; documents ascend. Small numbers sort by digits."""
    order = np.argsort(tokens.astype(np.uint16) if len(tokens) and tokens.max() < 1 << 16 else tokens, kind="stable")
    token, doc = tokens[order], docs[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return token[first], doc[first], np.diff(first, append=len(token))


class Shard:
    """The unused rests of documents with their inverted index."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.ids, n = ids, len(ids)
        self.left = np.array([len(x) for x in ids], np.int64)
        self.at = np.zeros(n, np.int64)
        token, doc, tf = counted(np.concatenate(ids).astype(np.int64), np.repeat(np.arange(n), self.left))
        telling = idf[token] > 0
        token, self.doc, tf = token[telling], doc[telling], tf[telling]
        self.tokens, self.first = np.unique(token, return_index=True)
        self.first = np.append(self.first, len(token))
        self.weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.left[self.doc] / mean))
        own, of, _ = counted(self.doc, np.repeat(np.arange(len(self.tokens)), np.diff(self.first)))
        self.own = np.split(of, np.searchsorted(own, np.arange(1, n)))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents with a token of the seed's, by falling BM25, equal ones in order."""
        of = self.own[seed]
        place = ragged(self.first[of], self.first[of + 1] - self.first[of])
        score = np.bincount(self.doc[place], self.weight[place], len(self.ids))
        fit = np.flatnonzero((score > 0) & (self.left > 0))
        return fit[np.argsort(-score[fit], kind="stable")]

    def sequences(self, size: int) -> Iterator[list[tuple[int, int, int]]]:
        """Whole sequences as lists of pieces (document, start, length), as long as there are tokens for one."""
        rest, low = int(self.left.sum()), 0
        while rest >= size:
            while not self.left[low]:
                low += 1
            room, out = size, []

            def put(i: int) -> None:
                nonlocal room
                n = min(room, int(self.left[i]))
                out.append((i, int(self.at[i]), n))
                self.at[i] += n
                self.left[i] -= n
                room -= n

            seed = low
            put(seed)
            for i in self.neighbours(seed).tolist() if room else ():
                put(i)
                if not room:
                    break
            following = low
            while room:
                if self.left[following]:
                    put(following)
                following += 1
            rest -= size
            yield out


def packed(rests: DataFrame, idf: np.ndarray, mean: float, size: int) -> DataFrame:
    """Pieces of the sequences of each task; ``shard`` numbers tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, doc_tokens, start, ids)
        tokens = number = shard = 0

        def pieces(found: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal number
            flat = [(i, a, n, number + k) for k, one in enumerate(found) for i, a, n in one]
            number += len(found)
            length = np.array([n for _, _, n, _ in flat], np.int64)
            sequence = np.array([s for *_, s in flat], np.int64)
            before = np.cumsum(length) - length
            offset = before - before[np.searchsorted(sequence, sequence)] if len(flat) else before
            ids = np.concatenate([held[i][3][a : a + n] for i, a, n, _ in flat]) if flat else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([held[i][0] for i, *_ in flat], pa.int64()), pa.array([held[i][2] + a for i, a, *_ in flat], pa.int64()), binary(ids, np.append(before, length.sum())), pa.array([held[i][1] for i, *_ in flat], pa.int64()), pa.array(2 * ((shard << 36) + sequence) + 1), pa.array(offset)],
                ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        def fill() -> pa.RecordBatch:
            nonlocal tokens
            index = Shard([h[3] for h in held], idf, mean)
            out = pieces(list(index.sequences(size)))
            held[:] = [(d, t, s + int(a), x[a:]) for (d, t, s, x), a, n in zip(held, index.at, index.left, strict=True) if n]
            tokens = int(index.left.sum())
            return out

        def last() -> pa.RecordBatch:
            """The rest of less than a sequence, in powers of two."""
            found, i, at, left = [], 0, 0, tokens
            while left:
                room = 1 << (left.bit_length() - 1)
                left, one = left - room, []
                while room:
                    n = min(room, len(held[i][3]) - at)
                    one.append((i, at, n))
                    room, at = room - n, at + n
                    if at == len(held[i][3]):
                        i, at = i + 1, 0
                found.append(one)
            return pieces(found)

        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                shard = r[4]
                held.append((r[0], r[1], r[2], np.frombuffer(r[3], "<u4")))
                tokens += len(held[-1][3])
                if tokens >= SHARD_TOKENS:
                    yield fill()
        if held:
            yield fill()
            yield last()

    return rests.mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): every token of every document in one piece; ``ids`` are
    little-endian 32-bit numbers."""
    table = written(encoded(docs, path, size, end), "tokens", compression="zstd")
    rows = table.where("ids is not null").select("doc_id", "doc_tokens", "start", "ids", "near", "nearer")
    whole = F.octet_length("ids") == 4 * size
    facts = rows.agg(F.count_if(F.col("start") == 0).alias("docs"), F.count_if(~whole).alias("rests"), F.coalesce(F.sum(F.when(~whole, F.octet_length("ids"))), F.lit(0)).alias("bytes")).first()
    counts = table.where("ids is null").groupBy("token").agg(F.sum("df").alias("df")).collect()  # a row for each token of the vocabulary at most
    df = np.zeros(max((r["token"] for r in counts), default=0) + 1)
    df[[r["token"] for r in counts]] = [r["df"] for r in counts]
    idf = np.maximum(0.0, np.log((facts["docs"] - df + 0.5) / (df + 0.5)))  # tokens of more than half of the documents tell nothing
    shards = max(1, -(-facts["bytes"] // (4 * SHARD_TOKENS)))
    dealt = rows.where(~whole).repartitionByRange(shards, "near", "nearer", F.xxhash64("doc_id", "ids")).sortWithinPartitions("near", "nearer", "doc_id", "ids")
    rests = packed(dealt.select("doc_id", "doc_tokens", "start", "ids", F.spark_partition_id().cast("long").alias("shard")), idf, max(1.0, facts["bytes"] / 4 / max(1, facts["rests"])), size)
    alone = rows.where(whole).select("doc_id", "start", "ids", "doc_tokens", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(rests)


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, piece by piece."""
    found = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"))
    return found.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
