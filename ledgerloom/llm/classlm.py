"""Operator 7: perplexity under a Brown class-based n-gram model.

P(word | word before) = P(class | class before) * P(word | class). Words of the training documents are
counted over the whole corpus. Exchange clustering assigns every one of them to a class by its own contexts:

0. documents are dealt into chunks and cut into words once: a chunk keeps its distinct words, the sequence of
   their places and the bounds of its documents in one compressed body, and sends each distinct word with its
   training count to the word's bucket. All that follows reads bodies, not texts;
1. a first dealing: the most frequent ``TOP`` words are units of their own, all others are grouped by a
   hash of their last three bytes into ``GROUPS`` units, and the end of a text is a unit. Exchange
   clustering of the units on the driver (moving one unit at a time to the class that raises the
   class-bigram likelihood most) gives ``CLASSES`` classes, and each of them but that of the end is dealt
   into as many parts as the vocabulary asks for (``parts_for``: classes grow as its cube root);
2. rounds over all words: chunks count the classes before and after each of their words that may move and send
   these counts to the word's bucket; with the table of class bigrams broadcast, each word of half the
   vocabulary (every other one by hash, in turn) goes to the class under which its contexts are most likely. Words of one
   round move at once, each against the table without itself; a round that lowers the likelihood is undone.

Only words that no training document has take the most frequent class of the words with their ending.
Tables of units and of class bigrams are all that comes to the driver. Both probabilities are smoothed:
transitions with the class frequencies, emissions by adding ``ADD`` for each known word of the class and
once for all unknown ones.

Defined results: null and empty texts hold one token, their end; a null doc_id counts as empty text in
crc32 and comes back null; with no training document all counts are 0; repeated rows each count and are
each returned; other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir

from . import chunks as C

TOP, GROUPS, CLASSES, ADD, BACK = 511, 512, 64, 0.1, 20.0
ROUNDS = 2
UNITS = TOP + GROUPS + 1
END = UNITS - 1


def endings(data: np.ndarray, words: C.Words) -> np.ndarray:
    """Group of each word, by its last three bytes."""
    v = np.zeros(len(words.hash), np.uint64)
    for k in (1, 2, 3):
        at = words.end - k
        v = v * np.uint64(257) + np.where(at >= words.start, C._LOWER[data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (C.mix(v) % np.uint64(GROUPS)).astype(np.int64)


def counted(data: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, C.Words]:
    """Distinct words of some texts in order of hash: hash, count in training texts, group; each word's place; the words."""
    words = C.words_of(data, offsets, lower=True)
    u, one, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    counts = np.bincount(inverse, train[words.doc], len(u)).astype(np.int64)
    return u, counts, endings(data, words)[one] if len(u) else np.zeros(0, np.int64), inverse, words


def units_of(u: np.ndarray, group: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Unit of each distinct word; ``top``: sorted hashes of the frequent words."""
    if not len(top):
        return TOP + group
    at = np.minimum(np.searchsorted(top, u), len(top) - 1)
    return np.where(top[at] == u, at, TOP + group)


def summed(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of several blocks with their counts added."""
    u, one, inverse = np.unique(np.concatenate([b[0] for b in blocks]), return_index=True, return_inverse=True)
    return u, np.bincount(inverse, np.concatenate([b[1] for b in blocks]), len(u)).astype(np.int64), np.concatenate([b[2] for b in blocks])[one]


ENCODED = "chunk int, bucket int, words binary, counts binary, groups binary, body binary"
#: What a body holds: name and type of each array.
BODY = {"group": np.int16, "order": np.int32, "low": np.uint8, "high": np.uint16, "sizes": np.int64, "train": np.bool_, "doc_id": np.int64}


def encoded(dealt: DataFrame, buckets: int) -> DataFrame:
    """For each chunk its body (bucket -1), and for each bucket the chunk's distinct words with training counts and groups."""

    def run(table: pa.Table) -> pa.Table:
        chunk, train = table["chunk"][0].as_py(), table["train"].to_numpy()
        u, counts, group, inverse, words = counted(*C.text_buffer(table["text"]), train.astype(float))
        have, bounds = C.deal(C.bucket_of(u, buckets), buckets)
        parts = [[C.squeezed_sorted(u[a:b]), C.squeezed(counts[a:b].astype(np.int32)), C.squeezed(group[a:b].astype(np.int16))] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        order = np.argsort(-np.bincount(inverse, minlength=len(u)), kind="stable")  # frequent words have small ranks, which are short when squeezed
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        rank = rank[inverse]
        body = {"group": group, "order": order, "low": rank & 255, "high": rank >> 8, "sizes": words.counts, "train": train, "doc_id": table["doc_id"].to_numpy()}
        body = b"".join(len(x).to_bytes(8, "little") + x for x in (C.squeezed(body[k].astype(t)) for k, t in BODY.items()))
        cols = [pa.array([x[i] for x in parts] + [None], pa.binary()) for i in range(3)]
        return pa.table([pa.array(np.full(len(have) + 1, chunk, np.int32)), pa.array(np.append(have, -1).astype(np.int32)), *cols, pa.array([None] * len(have) + [body], pa.binary())], ["chunk", "bucket", "words", "counts", "groups", "body"])

    return dealt.groupBy("chunk").applyInArrow(run, ENCODED)


def body_of(blob: bytes) -> dict[str, np.ndarray]:
    """The arrays of a body."""
    out, at = {}, 0
    for k, t in BODY.items():
        size = int.from_bytes(blob[at : at + 8], "little")
        out[k] = C.opened(blob[at + 8 : at + 8 + size], t)
        at += 8 + size
    out["place"] = out.pop("order")[out.pop("low").astype(np.int64) + (out.pop("high").astype(np.int64) << 8)]
    return out


def laid_out(parts: DataFrame, chunks: int) -> DataFrame:
    """``parts`` as a table in the shared folder that is bucketed by chunk: what follows joins a chunk's words to its body
    in every round without moving bodies again."""
    spark, name = parts.sparkSession, f"class_lm_{uuid.uuid4().hex}"
    parts.write.bucketBy(min(chunks, 4096), "chunk").option("path", f"{checkpoint_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def vocabulary(asked: DataFrame) -> DataFrame:
    """All training words of each bucket in order of hash (chunk -1: words, counts, groups), and for each block of words
    that a chunk asked about their places among them, the number of them where unknown (chunk, place)."""

    def of_bucket(table: pa.Table) -> pa.Table:
        blocks = [C.opened_sorted(x) for x in table["words"].to_pylist()]
        opened = lambda c, t: [C.opened(x, t) for x in table[c].to_pylist()]
        u, n, g = summed(list(zip(blocks, opened("counts", np.int32), opened("groups", np.int16), strict=True)))
        u, n, g = u[n > 0], n[n > 0], g[n > 0].astype(np.int64)
        places = []
        for x in blocks:
            at = np.searchsorted(u, x)
            at[np.append(u, np.uint64(0))[at] != x] = len(u)
            places.append(C.squeezed(np.diff(at, prepend=0).astype(np.int32)))
        none = [None] * len(blocks)
        of_words = {k: pa.array([x.tobytes(), *none], pa.binary()) for k, x in (("words", u), ("counts", n), ("groups", g))}
        return pa.table({"chunk": pa.array([-1, *table["chunk"].to_pylist()], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * (1 + len(blocks)), pa.int32()), **of_words, "place": pa.array([None, *places], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(of_bucket, "chunk int, bucket int, words binary, counts binary, groups binary, place binary")


def by_row(table: DataFrame, schema: str, made) -> DataFrame:
    """What ``made`` gives for each row of a table of buckets, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from pa.table(made(row)).to_batches()

    return table.mapInArrow(run, schema)


def most_frequent(row: dict) -> dict:
    """Rows (kind, key, n, v) about a bucket: its most frequent words (kind 0: hash, count, group) and sums
    by group (kind 1: group, tokens, distinct words)."""
    u, n, g = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["groups"], np.int64)
    best = np.lexsort((u, -n))[:TOP]
    tokens, distinct = np.bincount(g, n, GROUPS).astype(np.int64), np.bincount(g, minlength=GROUPS)
    return {"kind": pa.array(np.repeat(np.array([0, 1], np.int32), [len(best), GROUPS])), "key": pa.array(np.append(u[best].view(np.int64), np.arange(GROUPS))), "n": pa.array(np.append(n[best], tokens)), "v": pa.array(np.append(g[best], distinct))}


def unit_bigrams(bodies: DataFrame, asked: DataFrame, known: DataFrame, top: np.ndarray) -> np.ndarray:
    """Counts of neighbouring units in training texts, first by second; the end comes last."""

    def units(row: dict) -> dict:
        u = np.frombuffer(row["words"], np.uint64)
        unit = 1 + units_of(u, np.frombuffer(row["groups"], np.int64), top)
        return {"bucket": pa.array([row["bucket"]], pa.int32()), "counts": pa.array([row["counts"]]), "cls": pa.array([unit.astype(np.int32).tobytes()])}

    counted = class_table(contexts(bodies, asked, by_row(known, STATE, units), UNITS, None), UNITS)
    last = np.roll(np.arange(UNITS), -1)
    return counted[np.ix_(last, last)]


def padded(units: np.ndarray, sizes: np.ndarray, end: int = END) -> np.ndarray:
    """One row of units for all texts of ``sizes`` words: an end before the first text and after each."""
    out = np.full(len(units) + len(sizes) + 1, end, np.int64)
    out[np.arange(len(units)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = units
    return out


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 6) -> np.ndarray:
    """Class of each unit. The last unit keeps class 0 to itself; the others start dealt by frequency and
    move, one at a time, to the class that raises sum N(c,d) log N(c,d) - sum N(c) log N(c) twice most."""
    n = len(bigrams)
    a = bigrams.astype(float)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    order = np.argsort(-a.sum(axis=0)[: n - 1], kind="stable")
    cls = np.zeros(n, np.int64)
    cls[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    g = member.T @ a @ member
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not (a[w].any() or a[:, w].any()):
                continue
            k, own = cls[w], a[w, w]
            out, into = a[w] @ member, a[:, w] @ member
            out[k] -= own
            into[k] -= own
            g[k] -= out
            g[:, k] -= into
            g[k, k] -= own
            fg, row, col = f(g), g.sum(axis=1), g.sum(axis=0)
            gain = (f(g + out) - fg).sum(axis=1) + (f(g + into[:, None]) - fg).sum(axis=0)
            d = np.diag(g)
            gain += f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
            gain -= f(row + out.sum() + own) - f(row) + f(col + into.sum() + own) - f(col)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9 * abs(gain[k]):
                best = k
            g[best] += out
            g[:, best] += into
            g[best, best] += own
            if best != k:
                member[w, k], member[w, best], cls[w] = 0, 1, best
                moved += 1
        if not moved:
            break
    return cls


def parts_for(words: int) -> int:
    """Parts of each class of the first dealing, for a vocabulary of so many words."""
    return max(1, round(1.5 * words ** (1 / 3) / (CLASSES - 1)))


STATE = "bucket int, counts binary, cls binary"


def looked_up(asked: DataFrame, state: DataFrame) -> DataFrame:
    """(chunk, bucket, place, counts, cls): for each block of places also counts (0 where unknown) and classes (-1)."""

    def find(table: pa.Table, have: pa.Table) -> pa.Table:
        n = np.append(np.frombuffer(have["counts"][0].as_py(), np.int64) if len(have) else np.zeros(0, np.int64), 0)
        cls = np.append(np.frombuffer(have["cls"][0].as_py(), np.int32) if len(have) else np.zeros(0, np.int32), -1)
        at = [np.cumsum(C.opened(x, np.int32)) for x in table["place"].to_pylist()]
        return pa.table({**{k: table[k] for k in ("chunk", "bucket", "place")}, "counts": pa.array([C.squeezed(n[x]) for x in at], pa.binary()), "cls": pa.array([C.squeezed(cls[x].astype(np.int32)) for x in at], pa.binary())})

    return asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(find, "chunk int, bucket int, place binary, counts binary, cls binary")


def of_chunk(given: pa.Table, column: str, dtype) -> list[np.ndarray]:
    """What the buckets answered about a chunk's distinct words, in their order."""
    got = dict(zip(given["bucket"].to_pylist(), given[column].to_pylist(), strict=True))
    return [C.opened(got[b], dtype) for b in sorted(got)]


def joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *parts])


GATHERED = "bucket int, place binary, context binary, n binary"


def contexts(bodies: DataFrame, asked: DataFrame, state: DataFrame, classes: int, turn: int | None) -> DataFrame:
    """What a round needs of each chunk: for each bucket the contexts of its words that may move in this ``turn`` (every
    other one; none without a turn): place of the word, context (class after it, or ``classes`` + class before it) and
    count; and in bucket -1 the chunk's class bigrams (context: the pair)."""

    def count(table: pa.Table, given: pa.Table) -> pa.Table:
        body = body_of(table["body"][0].as_py())
        train, inverse, doc_words = body["train"], body["place"], body["sizes"]
        blocks = of_chunk(given, "cls", np.int32)
        cls, place = joined(blocks, np.int32).astype(np.int64), joined([np.cumsum(x) for x in of_chunk(given, "place", np.int32)], np.int64)
        word = padded(inverse, doc_words, -1)
        side = np.where(word < 0, 0, np.append(cls, 0)[word])
        keep = np.repeat(train, doc_words + 1)
        left, right, before, after = word[:-1][keep], word[1:][keep], side[:-1][keep], side[1:][keep]
        pair, pair_n = np.unique(before * classes + after, return_counts=True)
        order, bounds, parts = [], np.zeros(1, np.int64), {"place": place[:0], "context": place[:0], "n": place[:0]}
        if turn is not None:
            may = np.append(place % 2 == turn % 2, False)  # the last: ends
            a, b = may[left], may[right]
            key, n = np.unique(np.append(left[a] * (2 * classes) + after[a], right[b] * (2 * classes) + classes + before[b]), return_counts=True)
            w = key // (2 * classes)
            order = sorted(given["bucket"].to_pylist())
            bounds = np.searchsorted(w, np.cumsum([0, *map(len, blocks)]))
            parts = {"place": place[w], "context": key % (2 * classes), "n": n}
        cut = lambda k, x: (np.diff(x, prepend=0) if k == "place" else x).astype(np.int32)
        more = {"place": np.zeros(0, np.int32), "context": pair.astype(np.int32), "n": pair_n.astype(np.int32)}
        return pa.table({"bucket": pa.array([*order, -1], pa.int32()), **{k: pa.array([*(C.squeezed(cut(k, x[i:j])) for i, j in zip(bounds[:-1], bounds[1:], strict=True)), C.squeezed(more[k])], pa.binary()) for k, x in parts.items()}})

    answers = looked_up(asked, state).select("chunk", "bucket", "cls", "place")
    return bodies.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(count, GATHERED)


def class_table(gathered: DataFrame, classes: int) -> np.ndarray:
    """Counts of class bigrams over all chunks."""
    rows = by_row(gathered.where("bucket < 0"), "pair long, n long", lambda row: {"pair": C.opened(row["context"], np.int32).astype(np.int64), "n": C.opened(row["n"], np.int32).astype(np.int64)})
    rows = rows.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    g = np.zeros(classes * classes, np.int64)
    g[rows["pair"].to_numpy(np.int64)] = rows["n"]
    return g.reshape(classes, classes)


def after_moves(gathered: DataFrame, state: DataFrame, g: np.ndarray, turn: int) -> DataFrame:
    """``state`` after the words of this turn have moved."""
    width = 2 * len(g)

    def move(table: pa.Table, have: pa.Table) -> pa.Table:
        if not len(have):
            return pa.table({"bucket": pa.array([], pa.int32()), "counts": pa.array([], pa.binary()), "cls": pa.array([], pa.binary())})
        part = lambda k: [C.opened(x, np.int32) for x in table[k].to_pylist()]
        place = joined([np.cumsum(x, dtype=np.int64) for x in part("place")], np.int64)
        key, inverse = np.unique(place * width + joined(part("context"), np.int32), return_inverse=True)
        n = np.bincount(inverse, joined(part("n"), np.int32), len(key)).astype(np.int64)
        cls = np.frombuffer(have["cls"][0].as_py(), np.int32)
        cls = moved(cls, np.arange(len(cls)) % 2 == turn % 2, key // width, key % width, n, g)
        return pa.table({"bucket": have["bucket"], "counts": have["counts"], "cls": pa.array([cls.tobytes()], pa.binary())})

    return gathered.where("bucket >= 0").groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(move, STATE)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(g: np.ndarray) -> float:
    g = g.astype(float)
    return float(xlogx(g).sum() - xlogx(g.sum(axis=0)).sum() - xlogx(g.sum(axis=1)).sum())


def moved(cls: np.ndarray, may: np.ndarray, place: np.ndarray, context: np.ndarray, n: np.ndarray, g: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """New classes of a bucket's words: for those that ``may`` move the class under which their contexts are most likely,
    given the table ``g`` of class bigrams without the word. ``place`` (sorted), ``context`` and ``n``: the words' contexts.
    Probabilities are smoothed, or else all rare words would go to small classes at once."""
    cls, g = cls.astype(np.int64), g.astype(float)
    classes, row, col = len(g), g.sum(axis=1), g.sum(axis=0)
    base = np.concatenate([g.T + BACK * (col / max(col.sum(), 1))[:, None], g + BACK * (row / max(row.sum(), 1))[:, None]])  # row: a context; column: a word's class
    whole = np.stack([row, col]) + BACK
    table = np.log(np.maximum(base, 1e-9)) - np.log(np.repeat(whole, classes, axis=0))
    table = table.astype(np.float32)
    keep = may[place]
    place, context, n = place[keep], context[keep], n[keep]
    edges = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place)) if len(place) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + block, side="right")) - 1)
        a, b, start = edges[lo], edges[hi], edges[lo:hi] - edges[lo]
        w, c, m = place[a + start], context[a:b], n[a:b]
        k, own = cls[w], cls[place[a:b]]
        gain = np.add.reduceat(table[c] * m[:, None].astype(np.float32), start, axis=0).astype(float)
        total = np.add.reduceat(np.where(c < classes, m, 0), start)  # a word has as many bigrams before as after it
        left = np.repeat(total, np.diff(np.append(start, b - a)))
        stay = np.add.reduceat(m * (np.log(np.maximum(base[c, own] - m, 1e-9)) - np.log(whole[c // classes, own] - left)), start)
        gain[:, 0] = -np.inf
        gain[np.arange(len(w)), k] = stay
        best = gain.argmax(axis=1)
        cls[w] = np.where(gain[np.arange(len(w)), best] > stay + 1e-5 * np.abs(stay), best, k)
        lo = hi
    return cls.astype(np.int32)


class Model:
    """The fitted probabilities, in log10; ``state`` holds each word's class and count by bucket."""

    def __init__(self, bodies: DataFrame, asked: DataFrame, texts: int, rounds: int = ROUNDS):
        checkpoint_dir(bodies.sparkSession)
        both = vocabulary(asked).checkpoint()
        known, asked = both.where("chunk < 0").drop("chunk", "place"), both.where("chunk >= 0").select("chunk", "bucket", "place")
        stats = by_row(known, "kind int, key long, n long, v long", most_frequent).checkpoint()
        top = stats.where("kind = 0").orderBy(F.desc("n"), "key").limit(TOP).toPandas()
        by_group = stats.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()
        top = np.sort(top["key"].to_numpy(np.int64).view(np.uint64))
        unit_cls = exchange(unit_bigrams(bodies, asked, known, top))
        self.texts, self.tokens, self.distinct = texts, int(by_group["n"].sum()) + texts, int(by_group["v"].sum()) + int(texts > 0)
        parts = parts_for(self.distinct)
        classes = 1 + (CLASSES - 1) * parts

        def first(row: dict) -> dict:
            u = np.frombuffer(row["words"], np.uint64)
            cls = unit_cls[units_of(u, np.frombuffer(row["groups"], np.int64), top)] + (CLASSES - 1) * (C.mix(u) % np.uint64(parts)).astype(np.int64)
            return {"bucket": pa.array([row["bucket"]], pa.int32()), "counts": pa.array([row["counts"]]), "cls": pa.array([cls.astype(np.int32).tobytes()])}

        self.likelihoods: list[float] = []
        state, best = by_row(known, STATE, first).checkpoint(), None
        for k in range(rounds + 1):
            gathered = contexts(bodies, asked, state, classes, k if k < rounds else None).checkpoint()
            g = class_table(gathered, classes)
            self.likelihoods.append(likelihood(g))
            if best and self.likelihoods[-1] <= likelihood(best[1]):
                break
            best = state, g
            if k < rounds:
                state = after_moves(gathered, state, g, k).checkpoint()
        self.state, pair = best
        self.asked = asked

        def sizes(row: dict) -> dict:
            cls = np.frombuffer(row["cls"], np.int32)
            return {"cls": np.arange(classes), "tokens": np.bincount(cls, np.frombuffer(row["counts"], np.int64), classes).astype(np.int64), "kinds": np.bincount(cls, minlength=classes)}

        of_class = by_row(self.state, "cls long, tokens long, kinds long", sizes).groupBy("cls").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).toPandas()
        size, kinds = np.zeros(classes), np.zeros(classes)
        size[of_class["cls"]], kinds[of_class["cls"]] = of_class["tokens"], of_class["kinds"]
        size[0], kinds[0] = texts, texts > 0

        def endings_of(row: dict) -> dict:
            u, n = np.unique(np.frombuffer(row["groups"], np.int64) * classes + np.frombuffer(row["cls"], np.int32), return_counts=True)
            return {"key": u // classes, "cls": u % classes, "n": n}

        by_ending = by_row(self.state.join(known.select("bucket", "groups"), "bucket"), "key long, cls long, n long", endings_of).groupBy("key", "cls").agg(F.sum("n").alias("n"))
        by_ending = by_ending.groupBy("key").agg(F.max(F.struct("n", F.col("cls"))).alias("most")).select("key", "most.cls").toPandas()
        self.of_ending = unit_cls[TOP : TOP + GROUPS].copy()
        self.of_ending[by_ending["key"]] = by_ending["cls"]
        share = (size + ADD) / (size + ADD).sum()
        self.transition = np.log10((pair + BACK * share) / (pair.sum(axis=1, keepdims=True) + BACK))
        self.divisor = size + ADD * (kinds + 1)

    def sent(self) -> Model:
        """What tasks need of it."""
        out = object.__new__(Model)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("state", "asked")}
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def score(docs: DataFrame, training) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; ``training``:
    a Column that says which documents to learn from."""
    plan = C.layout(docs)
    n = plan.buckets
    checkpoint_dir(docs.sparkSession)
    dealt = C.with_chunks(docs, plan.chunks, train=training)

    parts = laid_out(encoded(dealt, n), plan.chunks)
    bodies = parts.where("bucket < 0").select("chunk", "body")
    fitted = Model(bodies, parts.where("bucket >= 0"), docs.where(training).count())
    model = docs.sparkSession.sparkContext.broadcast(fitted.sent())

    def mark(table: pa.Table, given: pa.Table) -> pa.Table:
        m, body = model.value, body_of(table["body"][0].as_py())
        train, inverse, sizes = body["train"], body["place"], body["sizes"]
        counts, cls = joined(of_chunk(given, "counts", np.int64), np.int64), joined(of_chunk(given, "cls", np.int32), np.int32)
        cls = np.where(cls < 0, m.of_ending[body["group"]], cls)
        emit = np.log10((counts + ADD) / m.divisor[cls])
        docs_n = len(sizes)
        of = np.repeat(np.arange(docs_n), sizes)
        row = padded(inverse, sizes, -1)
        is_word = row >= 0
        classes = np.zeros(len(row), np.int64)
        classes[is_word] = cls[inverse]
        each = np.full(len(row), np.log10((m.texts + ADD) / m.divisor[0]))
        each[is_word] = emit[inverse]
        each = each[1:] + m.transition[classes[:-1], classes[1:]]
        doc = np.zeros(len(row), np.int64)
        doc[is_word] = of
        doc[np.cumsum(sizes + 1)] = np.arange(docs_n)
        sums = lambda x: np.bincount(of, x[inverse], docs_n)
        return pa.table({
            "doc_id": pa.array(body["doc_id"]),
            "held_out": pa.array(~train),
            "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array((sums((counts > 0).astype(float)) + (m.texts > 0)).astype(np.int64)),
            "train_tokens": pa.array(np.full(docs_n, m.tokens, np.int64)),
            "base_score": pa.array(sums(m.base(counts)) + float(m.base(np.array(m.texts)))),
            "score": pa.array(np.bincount(doc[1:], each, docs_n)),
        })

    answers = looked_up(fitted.asked, fitted.state).select("chunk", "bucket", "counts", "cls")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return bodies.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(mark, schema).withColumn("doc_id", C.plain_id())


def op7_class_lm(spark, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32 modulo 10 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0)
