"""Operator 5: byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut into words by the tokenizer's pattern. For each word the encoder holds the boundaries
of its parts and, beside each boundary, the rank of joining the parts on both sides. It looks for the
least rank, deletes that boundary, refreshes the ranks of its neighbours, and repeats. Words over
``LONG`` bytes would cost the square of their length; the same merges come from a heap there. Words
repeat, so each Python worker keeps a bounded table of the words it has met.

Decoding looks up the bytes of every id and reads them as UTF-8, with U+FFFD for what is invalid.

Defined results: null text is empty and has no tokens; a special token's string in a text becomes its
id, as in the tokenizers library; repeated rows give one row each; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import text_buffer
from .suffixes import ragged

# Fixed value: the pattern of byte-level BPE pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 128
#: Most words that a worker's table holds: some 60 MB. Workers of earlier stages may stay beside those that encode, each with its own.
WORDS_KEPT = 200_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder(dict):
    """Words to their ids (as int32 bytes). It is the table of words met so far as well."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.step = len(spec["model"]["vocab"]) + 1
        self.rank_of, self.joined = {}, []
        for k, (a, b) in enumerate((to_bytes(a), to_bytes(b)) for a, b in pairs):
            self.rank_of[ids[a] * self.step + ids[b]] = k
            self.joined.append(ids[a + b])
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        table = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        size = np.zeros(max(table) + 1, np.int64)
        for i, b in table.items():
            size[i] = len(b)
        self.token_size, self.token_start = size, np.cumsum(size) - size
        self.token_bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(size))), np.uint8)
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        parts = self.merge_long(raw) if len(raw) > LONG else self.merge(raw)
        out = array("i", parts).tobytes()
        if len(raw) <= LONG:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = out
        return out

    def merge(self, raw: bytes) -> list[int]:
        """The ids of a short word's parts. Each entry of ``near`` is a boundary: the rank of joining both its sides."""
        rank, step, joined = self.rank_of.get, self.step, self.joined
        parts = [self.byte_ids[b] for b in raw]
        near = [rank(a * step + b, NEVER) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while near:
            least = min(near)
            if least == NEVER:
                break
            k = near.index(least)
            parts[k] = joined[least]
            del parts[k + 1], near[k]
            if k:
                near[k - 1] = rank(parts[k - 1] * step + parts[k], NEVER)
            if k < len(near):
                near[k] = rank(parts[k] * step + parts[k + 1], NEVER)
        return parts

    def merge_long(self, raw: bytes) -> list[int]:
        """The same ids for a long word, with a heap of (rank, start) and links between parts."""
        n = len(raw)
        stop, before = list(range(1, n + 1)), list(range(-1, n))
        alive = [True] * n
        parts = [self.byte_ids[b] for b in raw]
        rank, step, joined = self.rank_of.get, self.step, self.joined

        def offer(i: int) -> None:
            j = stop[i]
            if j < n and (r := rank(parts[i] * step + parts[j])) is not None:
                heapq.heappush(heap, (r, i, j, stop[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n):
            offer(i)
        while heap:
            r, i, j, k = heapq.heappop(heap)
            if not (alive[i] and stop[i] == j and j < n and alive[j] and stop[j] == k):
                continue
            stop[i], alive[j], parts[i] = k, False, joined[r]
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [parts[i] for i in range(n) if alive[i]]

    def encode(self, text: str) -> bytes:
        """The ids of a text, as int32 bytes."""
        if self.cut and any(s in text for s in self.special):
            return b"".join(np.int32(self.special[p]).tobytes() if p in self.special else b"".join([self[w] for w in self.words(p)]) for p in self.cut(text))
        return b"".join([self[w] for w in self.words(text)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        size = self.token_size[ids]
        data = self.token_bytes[ragged(self.token_start[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bpe_round_trip(docs: DataFrame, path: str, rows: int = 256) -> DataFrame:
    """(doc_id, ids, decoded): the token ids of each text, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                got = [enc.encode(t or "") for t in part.column(1).to_pylist()]
                counts = np.array([len(g) // 4 for g in got], np.int64)
                ids = np.frombuffer(b"".join(got), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(enc.decode(ids, counts), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded."""
    return digests(bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path()))
