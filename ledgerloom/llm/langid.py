"""Operator 4: language identification with averaged hashed subword embeddings.

A text is the mean of the embeddings of its byte 2-, 3- and 4-grams (ASCII letters lower-cased, other
ASCII made spaces, each n-gram hashed to a table row), followed by a linear softmax. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, in one task, on a bounded sample of
labelled documents: about ``SAMPLE_DOCS`` of up to ``SAMPLE_CHARS`` characters and ``SAMPLE_BYTES`` in all at
most, shared evenly by the (``MOST_LANGS`` most frequent) languages, each whole text cut into snippets. A fifth
of the sample is held back: it sets the temperature that calibrates the probabilities, and the level under which
a prediction is rejected (the one that ``REJECT`` of its correctly labelled snippets fall under, 0.4 at most).
Only the fitted tables, of a fixed size for each language, come to the driver, from where they are broadcast.

Every text is scored whole. Defined results: a null text or one without a letter is ``und`` with score
0 and rejected; with nothing to learn from, all texts are ``und``; a null doc_id counts as empty text in
crc32; of equally likely languages the first by name; repeated rows give one row each; other columns are
kept, but for columns named lang_pred, score or rejected, whose values are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .chunks import pieces, text_buffer

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES, MOST_LANGS, REJECT = 4_000, 100_000, 48 << 20, 1_000, 0.001
ROWS, DIM, GRAMS = 1 << 16, 8, (2, 3, 4)
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c


class Model(NamedTuple):
    """Embeddings of each n-gram size (the last row is zero), softmax weights, calibration."""

    languages: list[str]
    tables: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def gram_rows(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each n, the table row of the n-gram at each byte; ROWS where it would cross texts."""
    folded = _FOLD[data].astype(np.uint32)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out, h = [], folded.copy()
    for n in range(2, max(GRAMS) + 1):
        h[: len(h) - n + 1] = h[: len(h) - n + 1] * np.uint32(0x01000193) + folded[n - 1 :]
        x = h * np.uint32(0x9E3779B1) >> np.uint32(16)
        out.append(np.where(np.arange(len(h)) + n <= ends, x, ROWS).astype(np.int64))
    return out


def means(tables: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean embedding of each text."""
    n = len(offsets) - 1
    total, count = np.zeros((n, DIM)), np.zeros(n)
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    if len(full):
        for k, rows in zip(GRAMS, gram_rows(data, offsets), strict=True):
            total[full] += np.add.reduceat(tables[k - 2][rows], offsets[full], axis=0)
            count += np.maximum(size - k + 1, 0)
    return total / np.maximum(count, 1)[:, None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def snippets(texts: list[str], size: int = 300) -> tuple[list[bytes], list[int]]:
    """Each whole text cut into parts of about ``size`` bytes, and the text of each part."""
    parts, of = [], []
    for k, t in enumerate(texts):
        raw = t.encode()
        for lo in range(0, max(1, len(raw)), size):
            parts.append(raw[lo : lo + size])
            of.append(k)
    return parts, of


def train(texts: list[str], labels: list[str], steps: int = 1500, batch: int = 64, rate: float = 2.0, seed: int = 5) -> Model:
    """Fit on texts, every fifth of them held back for calibration."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    parts, of = snippets([texts[i] for i in fit])
    label = y[fit][of]
    tables = [np.zeros((ROWS + 1, DIM), np.float32) for _ in GRAMS]
    for t in tables:
        t[:ROWS] = rng.normal(0, 0.1, (ROWS, DIM))
    w, b = rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    by_label = [np.flatnonzero(label == k) for k in range(len(languages))]
    for step in range(steps):
        pick = np.array([rng.choice(by_label[k]) for k in rng.choice([k for k, x in enumerate(by_label) if len(x)], batch)])
        texts_now = [parts[i] for i in pick]
        data = np.frombuffer(b"".join(texts_now), np.uint8)
        off = np.append(0, np.cumsum([len(x) for x in texts_now]))
        mean = means(tables, data, off)
        g = softmax(mean @ w + b)
        g[np.arange(batch), label[pick]] -= 1
        lr = rate * (1 - step / steps)
        dmean = (g @ w.T) / np.maximum(sum(np.maximum(np.diff(off) - n + 1, 0) for n in GRAMS), 1)[:, None]
        w -= lr / batch * (mean.T @ g)
        b -= lr / batch * g.sum(axis=0)
        spread = np.repeat(dmean, np.diff(off), axis=0)
        for table, rows in zip(tables, gram_rows(data, off), strict=True):
            use, inverse = np.unique(rows, return_inverse=True)
            move = np.stack([np.bincount(inverse, spread[:, d], len(use)) for d in range(DIM)], axis=1)
            table[use] -= (lr * 20 * move).astype(np.float32)
            table[ROWS] = 0
    held_texts, of = snippets([texts[i] for i in held] or [""], 60)  # short, so that some are in doubt
    held_texts += [texts[i].encode() for i in held]  # and whole, as texts are predicted
    held = np.append(held[of], held) if len(held) else held
    data, off = np.frombuffer(b"".join(held_texts), np.uint8), np.append(0, np.cumsum([len(x) for x in held_texts]))
    logits = np.concatenate([means(tables, data[off[a] : off[c]], off[a : c + 1] - off[a]) for a, c in pieces(off)]) @ w + b
    truth = y[held] if len(held) else np.zeros(1, int)
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(logits / t)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    return Model(languages, tables, w, b, t, float(min(0.4, np.quantile(right, REJECT))) if len(right) else 0.0)


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame | None:
    """(text, lang, rank) of about ``sample_docs`` labelled rows of ``sample_bytes`` at most, chosen by a hash of id and
    text, evenly by language; rows equal in both count once. None where no row is labelled."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, max(1, sample_docs // len(counts)) / r["n"], sample_bytes / len(counts) / max(1, r["bytes"])))))
    rank = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return labelled.where(rank < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("text", "lang", rank.alias("rank")).dropDuplicates(["lang", "rank"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with lang_pred, score and rejected."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: 3 tables of 65,537 rows
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            p = [softmax((means(m.tables, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) @ m.weights + m.bias) / m.temperature) for a, b in pieces(offsets, 1 << 19)]
            p = np.concatenate(p) if p else np.zeros((0, len(m.languages)))
            best = p.argmax(axis=1)
            cols = [*batch.columns, pa.array([m.languages[k] for k in best], pa.string()), pa.array(p.max(axis=1) if len(p) else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.mapInArrow(run, schema).withColumns({
        "lang_pred": F.when(letter, F.col("lang_pred")).otherwise("und"),
        "score": F.when(letter, F.col("score")).otherwise(0.0),
    }).withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < model.reject_below))


def fit(docs: DataFrame, **bounds) -> Model | None:
    """A model of the labelled documents; None where none is labelled. The bounded sample is learned from in one task."""
    chosen = sample(docs, **bounds)
    if chosen is None:
        return None

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rank", "ascending"), ("text", "ascending"), ("lang", "ascending")])
        model = train(table["text"].to_pylist(), table["lang"].to_pylist())
        return pa.table({"model": pa.array([pickle.dumps(model._asdict())], pa.binary())})

    got = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "model binary").first()
    return Model(**pickle.loads(got["model"])) if got else None


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document, by a model of those whose crc32 modulo 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder(3) != 1))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
