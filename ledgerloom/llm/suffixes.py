"""Operator 10: removal of repeated byte strings with a suffix array built by two-stage sorting.

Each byte covered by a ``width``-byte string that also starts in a document with a smaller doc_id is
removed. Sorting every suffix of the corpus would move several times the input, so strings are first
narrowed down and dealt out:

1. every ``width``-byte window has an anchor: the ``ANCHOR``-byte string of least hash inside it
   (equal windows have equal anchors). Chunks send the hashes of their anchors, and buckets say which
   occur more than once, and which have more than ``HOT`` distinct runs (a short string common to many
   documents, or the edge of a popular passage, stands in another context in each);
2. neighbouring windows with equal anchors form a run of text (so a long stretch of one byte, or of a
   short period, is one run). Runs with a repeated anchor are sent,
   each distinct one once by each chunk with its smallest doc_id, to the bucket of their anchor. Runs of a hot anchor are split into single windows
   without context, which go to the bucket of the hash of the whole window: each chunk sends a window
   once, so what a bucket gets of it does not grow with the documents that have it;
3. a bucket builds the suffix array of its distinct runs. Two-stage sorting: only suffixes smaller
   than their successors are sorted directly; a scan of the buckets of first bytes, in order, induces
   all others from their successors. Adjacent suffixes with a common prefix of ``width`` bytes hold
   one string, whose smallest doc_id follows;
4. each chunk covers its bytes with the strings found and returns what is left.

Defined results: null text is empty; documents under ``width`` bytes keep all; a null doc_id is larger
than every other and comes back null; rows of one doc_id never remove each other's bytes; repeated rows
give one row each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .substring import ANSWER, blocks, repeated, shared

ANCHOR = 24
#: Anchors with more distinct runs than this are hot; chunks report those with more than ``FEW`` of their own.
HOT, FEW = 4096, 4
_LOW = np.uint64((1 << 28) - 1)


def anchor_at(data: np.ndarray, offsets: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each whole window of one piece of text: its start and the hash of its anchor."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = C.prefix_hash(data.astype(np.uint64) + np.uint64(1))
    at = np.arange(n - anchor + 1)
    h = C.mix((p[anchor:] - p[:-anchor]) * C.powers(len(p), inverse=True)[: len(at)])
    del p
    least = (h & ~_LOW) | (at.astype(np.uint64) & _LOW)  # of equal hashes the first place
    span, have = width - anchor + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: n - width + 1], least[span - have : span - have + n - width + 1])
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    start = np.repeat(offsets[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    low = (least[start] & _LOW).astype(np.int64)
    place = start + ((low - start) & int(_LOW))
    return start, C.mix(h[place])  # least hashes are small; mixed, they spread over the buckets


class Runs:
    """Runs of neighbouring windows with equal anchors: first and last window, document, hash of the anchor, the hash
    that deals them to buckets (that of the anchor, or of the window), and whether they are single windows of a hot anchor."""

    names = ("first", "last", "doc", "anchor", "key", "alone")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, anchor: int):
        got = []
        for lo, hi in C.pieces(offsets):
            base, off = int(offsets[lo]), offsets[lo : hi + 1] - offsets[lo]
            start, h = anchor_at(data[base : base + off[-1]], off, width, anchor)
            if not len(start):
                continue
            new = np.ones(len(start), bool)
            new[1:] = (h[1:] != h[:-1]) | (start[1:] != start[:-1] + 1)
            k = np.flatnonzero(new)
            got.append((start[k] + base, start[np.append(k[1:], len(start)) - 1] + base, np.searchsorted(off, start[k], side="right") - 1 + lo, h[k]))
        none = np.zeros(0, np.int64)
        self.first, self.last, self.doc, self.anchor = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (none, none, none, np.zeros(0, np.uint64))
        self.key, self.alone = self.anchor, np.zeros(len(self.first), bool)

    def keep(self, mask: np.ndarray) -> Runs:
        for name in self.names:
            setattr(self, name, getattr(self, name)[mask])
        return self

    def split(self, data: np.ndarray, hot: np.ndarray, width: int) -> Runs:
        """With the runs of hot anchors split into single windows."""
        if not hot.any():
            return self
        sizes = np.where(hot, self.last - self.first + 1, 1)
        at = np.repeat(np.arange(len(sizes)), sizes)
        self.first, last = ragged(self.first, sizes), self.last
        for name in ("doc", "anchor"):
            setattr(self, name, getattr(self, name)[at])
        self.alone = hot[at]
        self.last = np.where(self.alone, self.first, last[at])
        self.key = self.anchor.copy()
        one = self.first[self.alone]
        self.key[self.alone] = run_hash(data, one, one + width, np.zeros(len(one), bool))
        return self


def reach(data: np.ndarray, offsets: np.ndarray, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """For each run, the first place from its last window on whose suffix is smaller than its successor
    (else the document's last byte), and whether that byte is the document's last."""
    n = len(data)
    rising = np.zeros(n, bool)
    rising[:-1] = data[1:] > data[:-1]
    same = np.flatnonzero(data[1:] == data[:-1])  # equal bytes rise where the last of them does
    if len(same):
        last = np.append(np.flatnonzero(np.diff(same) != 1), len(same) - 1)
        rising[same] = np.repeat(rising[same[last] + 1], np.diff(last, prepend=-1))
    end = offsets[runs.doc + 1] - 1
    places = np.append(np.flatnonzero(rising), n)
    to = np.minimum(places[np.searchsorted(places, runs.last)], end)
    return to, to == end


def run_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Hash of each byte string data[start:end], with its length and flag."""
    out = np.zeros(len(start), np.uint64)
    for lo in range(0, len(start), 20_000):
        s, e = start[lo : lo + 20_000], end[lo : lo + 20_000]
        base, top = int(s.min()), int(e.max())
        out[lo : lo + 20_000] = C.span_hash(C.prefix_hash(data[base:top].astype(np.uint64) + np.uint64(1)), s - base, e - base)
    return C.mix(out ^ (((end - start).astype(np.uint64) << np.uint64(1)) | flag.astype(np.uint64)))


def context(data: np.ndarray, offsets: np.ndarray, runs: Runs, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run, the last suffix that is sorted with it, where its bytes end, whether that suffix is the document's
    last byte, and the hash of the bytes. Single windows of hot anchors are sorted directly: equal windows are all such."""
    to, at_end = reach(data, offsets, runs)
    to, at_end = np.where(runs.alone, runs.first, to), at_end & ~runs.alone
    stop = np.minimum(to + width, offsets[runs.doc + 1]) if len(to) else to
    return to, stop, at_end, run_hash(data, runs.first, stop, at_end)


def many_runs(data: np.ndarray, offsets: np.ndarray, runs: Runs, width: int, buckets: int) -> list[bytes]:
    """For each block of a chunk's distinct anchors, pairs (place in the block, distinct runs) of those with more than ``FEW``."""
    u, inverse, count = np.unique(runs.anchor, return_inverse=True, return_counts=True)
    have, bounds = C.deal(C.bucket_of(u, buckets), buckets)
    often = count[inverse] > FEW
    at = inverse[often]
    h = context(data, offsets, runs.keep(often), width)[3]
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(at[new], minlength=len(u))
    listed = np.flatnonzero(distinct > FEW)
    cut = np.searchsorted(listed, bounds)
    return [np.stack([listed[a:b] - lo, distinct[listed[a:b]]], axis=1).astype(np.int32).tobytes() for a, b, lo in zip(cut[:-1], cut[1:], bounds[:-1], strict=True)]


def shared_or_hot(table: pa.Table, hot: int) -> pa.Table:
    """The answers of ``shared``, and for each block with hot anchors their places in it (kind 3)."""
    values = C.arrays(table["block"], np.uint32)
    many = [x.reshape(-1, 2) for x in C.arrays(table["many"], np.int32)]
    u, inverse = np.unique(np.concatenate(values), return_inverse=True)
    runs = np.ones(len(inverse), np.int64)
    at = np.cumsum([0, *map(len, values)])
    for lo, x in zip(at[:-1], many, strict=True):
        runs[lo + x[:, 0]] = x[:, 1]
    is_hot = (np.bincount(inverse, runs, len(u)) > hot)[inverse]
    chunks, places = [], []
    for chunk, lo, hi in zip(table["chunk"].to_pylist(), at[:-1], at[1:], strict=True):
        if is_hot[lo:hi].any():
            chunks.append(chunk)
            places.append(np.flatnonzero(is_hot[lo:hi]).astype(np.int32).tobytes())
    buckets = table["bucket"].to_pylist()[: len(chunks)]
    more = pa.table({"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "kind": pa.array(np.full(len(chunks), 3, np.int32)), "answer": pa.array(places, pa.binary())})
    return pa.concat_tables([shared(table), more])


def hot_anchors(anchors: np.ndarray, buckets: int, given: dict[int, bytes]) -> np.ndarray:
    """Which anchors of a chunk are hot (``given``: the places by bucket)."""
    u, inverse = np.unique(anchors, return_inverse=True)
    have, bounds = C.deal(C.bucket_of(u, buckets), buckets)
    out = np.zeros(len(u), bool)
    for b, lo in zip(have.tolist(), bounds[:-1], strict=True):
        if b in given:
            out[lo + np.frombuffer(given[b], np.int32)] = True
    return out[inverse]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Sent:
    """The distinct runs of a chunk in the order in which they are sent, and each run's place among them."""

    def __init__(self, data, offsets, doc_ids, runs: Runs, width: int, buckets: int):
        to, stop, at_end, h = context(data, offsets, runs, width)
        u, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        least = np.full(len(u), C.NULL_ID, np.int64)
        np.minimum.at(least, inverse, doc_ids[runs.doc])
        bucket = C.bucket_of(runs.key[one], buckets)
        order = np.lexsort((least, bucket))
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        one = one[order]
        self.place, self.least, self.bucket = place[inverse], least[order], bucket[order]
        self.start, self.stop, self.to, self.at_end = runs.first[one], stop[one], to[one], at_end[one]
        self.windows = runs.last[one] - runs.first[one] + 1


def suffix_array(data: np.ndarray, start: np.ndarray, items: np.ndarray, stop: np.ndarray, at_end: np.ndarray, width: int) -> np.ndarray:
    """Places of the suffixes start, start + 1, ... of each run (``items`` of them) in the order of their
    first ``width`` bytes, by two-stage sorting. ``stop``: where each run's bytes end."""
    pos = ragged(start, items)
    if not len(pos):
        return pos
    run = np.repeat(np.arange(len(start)), items)
    final = np.zeros(len(pos), bool)
    final[np.cumsum(items) - 1] = True
    first = np.zeros(len(pos), bool)
    first[np.cumsum(items) - items] = True
    # smaller than the successor? equal first bytes: as the successor is
    byte = data[pos]
    way = np.zeros(len(pos), np.int8)
    way[:-1] = np.sign(byte[1:].astype(np.int16) - byte[:-1])
    way[final] = np.where(at_end, -1, 1)
    known = np.where(way != 0, np.arange(len(pos)), len(pos) - 1)
    small = way[np.minimum.accumulate(known[::-1])[::-1]] > 0
    # stage one
    direct = np.flatnonzero(small)
    order = direct[np.argsort(keys(data, pos[direct], stop[run[direct]], width), kind="stable")]
    cut = np.searchsorted(byte[order], np.arange(257))
    # stage two: buckets of first bytes in order; what an entry's predecessor is larger than comes after it
    ends = np.flatnonzero(final & ~small)
    larger: list[list[np.ndarray]] = [[ends[byte[ends] == c]] for c in range(256)]
    out = []
    for c in range(256):
        step = np.concatenate(larger[c])
        whole = [step]
        while len(step):
            before = step[~first[step]] - 1
            step = before[~small[before] & (byte[before] == c)]
            whole.append(step)
        whole.append(order[cut[c] : cut[c + 1]])
        entries = np.concatenate(whole)
        out.append(entries)
        before = entries[~first[entries]] - 1
        before = before[~small[before] & (byte[before] > c)]
        if len(before):
            b = byte[before]
            by = np.argsort(b, kind="stable")
            bounds = np.searchsorted(b[by], np.arange(c + 1, 257))
            for k in np.flatnonzero(np.diff(bounds)):
                larger[c + 1 + k].append(before[by[bounds[k] : bounds[k + 1]]])
    return pos[np.concatenate(out)]


def keys(data: np.ndarray, pos: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bytes at each place as fixed-size strings; zeros after the run's end."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[pos]
    short = np.flatnonzero(stop - pos < width)
    rows[short] = np.where(np.arange(width) < (stop - pos)[short, None], rows[short], 0)
    return np.ascontiguousarray(rows).view(f"S{width}")[:, 0]


def common(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Common prefix, up to ``width``, of each place's suffix with the one before it in the array."""
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    out = np.zeros(len(places), np.int64)
    for lo in range(1, len(places), 100_000):
        hi = min(len(places), lo + 100_000)
        differ = view[places[lo:hi]] != view[places[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return out


def strings_in_smaller(table: pa.Table, width: int) -> pa.Table:
    """For each block of runs, a bit for each window: whether another block has it with a smaller doc_id."""
    sizes = [np.frombuffer(x, np.int32).reshape(-1, 4) for x in table["sizes"].to_pylist()]
    ids = np.concatenate(C.arrays(table["ids"], np.int64))
    data = np.concatenate(C.arrays(table["bytes"], np.uint8))
    size, windows, items, at_end = np.concatenate(sizes).astype(np.int64).T
    start = np.cumsum(size) - size
    h = run_hash(data, start, start + size, at_end > 0)
    u, one, inverse = np.unique(h, return_index=True, return_inverse=True)
    least = np.full(len(u), C.NULL_ID, np.int64)
    np.minimum.at(least, inverse, ids)
    places = suffix_array(data, start[one], items[one], (start + size)[one], at_end[one] > 0, width)
    # keep whole windows; places of later suffixes served only to sort the others
    run_at = one[np.argsort(start[one], kind="stable")]
    run = run_at[np.searchsorted(start[run_at], places, side="right") - 1]
    whole = places - start[run] < windows[run]
    places, run = places[whole], run[whole]
    smallest = np.full(len(data), C.NULL_ID, np.int64)
    if len(places):
        new = np.flatnonzero(common(data, places, width) < width)
        least_of_run = least[inverse[run]]
        smallest[places] = np.repeat(np.minimum.reduceat(least_of_run, new), np.diff(np.append(new, len(places))))
    flags = smallest[ragged(start[one][inverse], windows)] < np.repeat(ids, windows)
    at, out = 0, []
    for x in sizes:
        n = int(x[:, 1].sum())
        out.append(np.packbits(flags[at : at + n]).tobytes())
        at += n
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "kind": pa.array(np.full(len(out), 2, np.int32)), "answer": pa.array(out, pa.binary())})


def remove_repeated_bytes(docs: DataFrame, width: int = 50, anchor: int = ANCHOR, chunk_bytes: int = 8 << 20, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each document, kept as bytes; see the module's text."""
    plan = C.layout(docs, chunk_bytes, bucket_bytes=8 << 20)
    n = plan.buckets
    dealt = C.with_chunks(docs, plan.chunks)

    def send_anchors(table: pa.Table) -> pa.Table:
        data, offsets = C.text_buffer(table["text"])
        runs = Runs(data, offsets, width, anchor)
        sent = blocks(table["chunk"][0].as_py(), runs.anchor, n)
        return sent.append_column("many", pa.array(many_runs(data, offsets, runs, width, n), pa.binary()))

    def prepare(table: pa.Table, masks: pa.Table):
        data, offsets = C.text_buffer(table["text"])
        doc_ids = table["doc_id"].to_numpy()
        runs = Runs(data, offsets, width, anchor)
        is_hot = hot_anchors(runs.anchor, n, C.answers(masks, 3))
        kept = repeated(runs.anchor, n, C.answers(masks, 1))
        runs.keep(kept).split(data, is_hot[kept], width)
        return data, offsets, doc_ids, runs, Sent(data, offsets, doc_ids, runs, width, n)

    def send_runs(table: pa.Table, masks: pa.Table) -> pa.Table:
        data, _, _, _, sent = prepare(table, masks)
        have, bounds = C.deal(sent.bucket, n)
        size = sent.stop - sent.start
        four = np.stack([size, sent.windows, sent.to - sent.start + 1, sent.at_end], axis=1).astype(np.int32)
        text = [data[ragged(sent.start[a:b], size[a:b])].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        chunk = table["chunk"][0].as_py() if len(table) else 0
        return pa.table({"chunk": pa.array(np.full(len(have), chunk, np.int32)), "bucket": pa.array(have.astype(np.int32)), "sizes": pa.array(C.blobs(four, bounds), pa.binary()), "ids": pa.array(C.blobs(sent.least, bounds), pa.binary()), "bytes": pa.array(text, pa.binary())})

    def keep(table: pa.Table, masks: pa.Table) -> pa.Table:
        data, offsets, doc_ids, runs, sent = prepare(table, masks)
        have, bounds = C.deal(sent.bucket, n)
        given = C.answers(masks, 2)
        flags = C.unpack([given[int(b)] for b in have], [int(sent.windows[a:b].sum()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        own = runs.last - runs.first + 1
        at = (np.cumsum(sent.windows) - sent.windows)[sent.place]
        gone = ragged(runs.first, own)[flags[ragged(at, own)] | np.repeat(doc_ids[runs.doc] > sent.least[sent.place], own)]
        step = np.zeros(len(data) + width + 1, np.int32)
        step[gone] += 1
        step[gone + width] -= 1
        left = np.cumsum(step)[: len(data)] == 0
        lost = np.append(0, np.cumsum(~left))
        n_removed = lost[offsets[1:]] - lost[offsets[:-1]]
        edge = ~left
        edge[1:] &= left[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        edge[starts] = ~left[starts]
        spans = np.append(0, np.cumsum(edge))
        raw, kept = data.tobytes(), []
        for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n_removed.tolist(), strict=True):
            kept.append(data[a:b][left[a:b]].tobytes() if r else raw[a:b])
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed), "n_spans": pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), "kept": pa.array(kept, pa.binary())})

    masks = dealt.groupBy("chunk").applyInArrow(send_anchors, "chunk int, bucket int, block binary, many binary").groupBy("bucket").applyInArrow(lambda t: shared_or_hot(t, hot), ANSWER)
    found = dealt.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(send_runs, "chunk int, bucket int, sizes binary, ids binary, bytes binary").groupBy("bucket").applyInArrow(lambda t: strings_in_smaller(t, width), ANSWER)
    kept = dealt.groupBy("chunk").cogroup(masks.unionAll(found).groupBy("chunk")).applyInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return kept.withColumn("doc_id", C.plain_id())


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes over all documents."""
    got = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
