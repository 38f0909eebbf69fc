"""Documents in chunks, and blocks of hashes that travel between chunks and buckets.

Several operators ask one question of the whole corpus about every position of every text ("does
this window occur elsewhere, and in which smallest document?"). One shuffled row for each position
would move several times the input. Instead:

1. documents are dealt into chunks by a hash (``with_chunks``), so that a chunk is a few MB of text;
2. for each chunk a task computes its distinct hashes with numpy and sends one block of them to each
   bucket (``deal``); a key is therefore sent at most once by each chunk, however hot it is;
3. for each bucket a task answers every block with one bit or number for each hash it got;
4. the chunk, grouped together with its answers, computes the same hashes again and reads the
   answers off in the same order.

Spark does all the dealing: chunks and buckets are ordinary grouping columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A null doc_id is treated as this one: larger than every other.
NULL_ID = (1 << 63) - 1
WORD_CLASS = r"[^\x20\x09-\x0D]+"
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Layout(NamedTuple):
    """How a corpus is dealt: numbers of chunks and buckets, bytes of text."""

    chunks: int
    buckets: int
    text_bytes: int


def layout(docs: DataFrame, chunk_bytes: int = 8 << 20, least_chunks: int = 64, bucket_bytes: int = 16 << 20) -> Layout:
    """Numbers that follow the input: chunks of ``chunk_bytes`` (up to 128 MB for large corpora) and
    a power of two of buckets."""
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    each = max(chunk_bytes, min(128 << 20, total // 4096))
    buckets = 1 << max(5, (max(1, total // max(bucket_bytes, each))).bit_length())
    return Layout(max(least_chunks, -(-total // each)), min(buckets, 1 << 20), total)


def with_chunks(docs: DataFrame, chunks: int, **more: Column) -> DataFrame:
    """(chunk, doc_id, text) of every document; null text is empty, null doc_id the largest. ``more``: further columns."""
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *(c.alias(k) for k, c in more.items()),
    )


def plain_id(column: str = "doc_id"):
    """The doc_id as given: null again where ``with_chunks`` made it the largest."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


# --- numpy helpers -------------------------------------------------------------------------------

_cache: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, base: int = _BASE, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or the same of its inverse."""
    have = _cache.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 16), step, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _cache[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Sums p with p[j] - p[i] = sum of values[k] * base**k for i <= k < j, modulo 2**64."""
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[start:end], the same wherever those values stand."""
    return mix((p[end] - p[start]) * powers(len(p), base, True)[start])


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one array of UTF-8 bytes, and the n + 1 offsets."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def pieces(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, so that 64-bit arrays over bytes stay small."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """Words of a chunk in order: hash, index of the document, byte range, first word of each document."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_docs + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words are maximal runs of bytes other than space and \\t..\\r; they never cross documents."""
    got: list[tuple[np.ndarray, ...]] = []
    for lo, hi in pieces(offsets):
        base, off = int(offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
        part = data[base : base + off[-1]]
        if not len(part):
            continue
        if lower:
            part = _LOWER[part]
        word = ~_SPACE[part]
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        edge = off[:-1][off[:-1] < len(part)]
        begin[edge] = word[edge]
        edge = off[1:][off[1:] > 0] - 1
        stop[edge] = word[edge]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        h = span_hash(prefix_hash(part.astype(np.uint64) + np.uint64(1)), s, e)
        got.append((h, np.searchsorted(off, s, side="right") - 1 + lo, s + base, e + base))
    if got:
        h, d, s, e = (np.concatenate(x) for x in zip(*got, strict=True))
    else:
        h, d, s, e = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return Words(h, d, s, e, np.searchsorted(d, np.arange(len(offsets))))


def windows_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside one document, and the index of their first word."""
    n = len(words.hash)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.arange(n - width + 1)
    start = start[words.doc[start] == words.doc[start + width - 1]]
    return span_hash(prefix_hash(words.hash, _BASE2), start, start + width, _BASE2), start


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its top bits (buckets is a power of two): sorted hashes are sorted by bucket."""
    return (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)


def deal(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket: the buckets that have rows, and len + 1 bounds of their ranges."""
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    have = np.flatnonzero(np.diff(bounds))
    return have, np.append(bounds[have], len(bucket))


def blobs(array: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The ranges of an array as bytes."""
    return [array[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def arrays(column, dtype) -> list[np.ndarray]:
    """The arrays that a binary Arrow column holds."""
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def unpack(masks, sizes) -> np.ndarray:
    """Bits of packed masks, each cut to its size, one after another."""
    if not len(masks):
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=int(n)) for m, n in zip(masks, sizes, strict=True)]).astype(bool)


def squeezed(array: np.ndarray) -> bytes:
    """An array as compressed bytes."""
    raw = np.ascontiguousarray(array)
    return raw.nbytes.to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw.tobytes(), asbytes=True)


def opened(blob: bytes, dtype) -> np.ndarray:
    """The array that ``squeezed`` made."""
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(blob[8:], size, asbytes=True), dtype)


def squeezed_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as compressed bytes: their differences, byte by byte of equal weight."""
    return squeezed(np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T))


def opened_sorted(blob: bytes) -> np.ndarray:
    """The values that ``squeezed_sorted`` took."""
    return np.cumsum(np.ascontiguousarray(opened(blob, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0], dtype=np.uint64)


def answers(table: pa.Table, kind: int | None = None) -> dict[int, bytes]:
    """The answers that a chunk got, by bucket."""
    if kind is not None:
        table = table.filter(pa.compute.equal(table["kind"], kind))
    return dict(zip(table["bucket"].to_pylist(), table["answer"].to_pylist(), strict=True))
