"""Operator 9: exact Jaccard join of word n-gram sets by partitioning the universe.

Two sets at least p percent alike differ in at most H tokens. All tokens are hashed into H + 1 segments;
by the pigeonhole principle two such sets are equal in one of them, so equal segment subsets give all
candidates. Sets are dealt into size bands that grow by 100 / p, so partners lie in one band or in
neighbours, and H follows the band.

Small subsets (most of all empty ones) are shared by many sets. A probing set therefore spends its
H + 1 units unevenly: it skips its R smallest subsets and, for R reserved segments, also looks for
subsets that differ by one token, through one-deletion neighbourhoods that are indexed for those
segments. R is chosen for each band by cost: signatures sent against expected false candidates.

Equal sets are one node. Blocks of signatures go to buckets; groups of up to ``SMALL`` nodes give all
their candidate pairs, larger ones first only pairs with their least node. Candidates whose
sizes and parity sketches allow it are verified exactly: a node's set is sent once to each chunk that
holds partners. Links give components. In
large groups only pairs between different components are then still open. First come rounds that are linear in
the members: in the few groups that each node picks it meets ``PIVOTS`` of the members, chosen by hash and so alike
in all groups, and what is verified is contracted; most copies of one text are connected by that. Then every
pair that is still open is looked at, in tasks that hold one block of a group against another. In the first of these
rounds each component sends on ``FEW`` pairs of each task, by the same hash everywhere, as most links would only
connect again what others have connected; the last round sends all that are still open, of the groups in which a
task had more than it sent: in all others every pair has been looked at.

Defined results: null text has no words; sets without words are empty, linked with nothing and their own
component; a null doc_id is larger than every other and comes back null; rows that share a doc_id are
separate documents with their own sets; repeated rows give one row each; other columns are not read.
Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_dir, release

from . import chunks as C
from .components import fitted, roots
from .suffixes import ragged

SMALL, BITS = 16, 128
#: How many 64-bit words of two sketches are compared first.
WORDS = 16
#: In how many groups each node meets pivots, how many pivots a group has.
PICKS, PIVOTS = 4, 3
#: Pairs that a component sends from one task in the rounds before the last, and those rounds.
FEW, FEW_ROUNDS = 4, 1
#: Members of a large group that are held against each other in one task.
BLOCK = 4096
#: Up to this many documents (12 bytes each) are named in a broadcast; beyond, all documents are dealt.
BROADCAST_ROWS = 1_000_000
INDEX, PROBE, DELETED = 1, 2, 4
_OTHER = np.uint64(0xA5A5A5A5F00DBEEF)


class Sets(NamedTuple):
    """Sets of shingles of some texts: sorted hashes, bounds (n + 1), digest."""

    hashes: np.ndarray
    first: np.ndarray
    digest: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> Sets:
    """Distinct shingles of ``width`` words of each text; of a shorter text its whole sequence."""
    words = C.words_of(data, offsets, lower=True)
    n = len(offsets) - 1
    h, start = C.windows_of(words, width)
    doc = words.doc[start]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        p = C.prefix_hash(words.hash, C._BASE2)
        h, doc = np.append(h, C.span_hash(p, words.first[short], words.first[short + 1], C._BASE2)), np.append(doc, short)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    first = np.searchsorted(doc, np.arange(n + 1))
    sums = np.append(np.uint64(0), np.cumsum(C.mix(h ^ _OTHER)))
    return Sets(h, first, C.mix((sums[first[1:]] - sums[first[:-1]]) + np.diff(first).astype(np.uint64)))


def bands(percent: int, most: int) -> list[int]:
    """Lower ends of the size bands up to ``most``: each at least 100 / percent times the one before."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


class Scheme(NamedTuple):
    """Segments and reserved segments of each band; 0 segments where only equal sets are alike."""

    lows: np.ndarray
    segments: np.ndarray
    reserved: np.ndarray


def scheme_for(percent: int, sizes: np.ndarray, counts: np.ndarray) -> Scheme:
    """The allocation for a corpus with ``counts`` sets of ``sizes``, by cost."""
    lows = np.array(bands(percent, int(sizes.max()) if len(sizes) else 1))
    n = np.bincount(np.searchsorted(lows, sizes, side="right") - 1, counts, len(lows))
    segments, reserved = np.zeros(len(lows), np.int64), np.zeros(len(lows), np.int64)
    for b in range(len(lows) - 1):
        small = int(lows[b + 1]) - 1
        differ = (100 - percent) * (small + small * 100 // percent) // (100 + percent)
        if not differ:
            continue
        m = segments[b] = differ + 1
        load = max(lows[b], 1) / m
        empty = math.exp(-load)
        mean = m * empty  # empty segments of a set, about a Poisson number
        sets = n[b] + (n[b + 1] if b + 1 < len(n) else 0)

        def cost(r: int) -> float:
            left, term, over = mean - r, math.exp(-mean), 0.0
            for x in range(r + 1):
                over += (r - x) * term
                term *= mean / (x + 1)
            return sets * r * 2 * (load + 1) + 50 * sets * max(0.0, left + over) * n[b] * empty

        reserved[b] = min(range(min(m // 2, 12) + 1), key=cost)
    return Scheme(lows, segments, reserved)


def signatures(sets: Sets, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, set and roles of every signature of the sets."""
    sizes = sets.sizes
    band = np.searchsorted(scheme.lows, sizes, side="right") - 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for back, roles in ((0, INDEX | PROBE), (1, PROBE)):
        use = np.flatnonzero((sizes > 0) & (band - back >= 0) & (scheme.segments[np.maximum(band - back, 0)] > 0))
        if not len(use):
            continue
        b = band[use] - back
        m, r = scheme.segments[b], scheme.reserved[b]
        at = np.cumsum(m) - m  # first segment of each set
        token = ragged(sets.first[use], sizes[use])
        own = np.repeat(np.arange(len(use)), sizes[use])
        h = C.mix(sets.hashes[token])
        seg = at[own] + ((h >> np.uint64(32)) % m[own].astype(np.uint64)).astype(np.int64)
        weight = C.mix(h ^ _OTHER)
        order = np.argsort(seg, kind="stable")
        total = int(m.sum())
        bounds = np.searchsorted(seg[order], np.arange(total + 1))
        sums = np.append(np.uint64(0), np.cumsum(weight[order]))
        subset = sums[bounds[1:]] - sums[bounds[:-1]]
        owner = np.repeat(np.arange(len(use)), m)
        local = np.arange(total) - at[owner]
        salt = C.mix((b[owner].astype(np.uint64) << np.uint64(32)) + local.astype(np.uint64) + np.uint64(1))
        spare = local < r[owner]
        # skip the r smallest subsets of each set that are not reserved
        by = np.lexsort((np.diff(bounds), spare, owner))
        rank = np.empty(total, np.int64)
        rank[by] = np.arange(total) - at[owner[by]]
        skip = ~spare & (rank < r[owner])
        role = np.where(skip, roles & ~PROBE, roles)
        keep = role > 0
        out.append((C.mix(subset + salt)[keep], use[owner][keep], role[keep]))
        cut = np.flatnonzero(spare[seg])
        out.append((C.mix(subset[seg[cut]] - weight[cut] + salt[seg[cut]]), use[own[cut]], np.full(len(cut), roles | DELETED)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    value, of, role = (np.concatenate(x) for x in zip(*out, strict=True))
    return value, of, role.astype(np.uint8)


def may_match(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two roles in one group make a candidate."""
    meet = ((x & PROBE) > 0) & ((y & INDEX) > 0) | ((x & INDEX) > 0) & ((y & PROBE) > 0)
    return meet & ~(((x & DELETED) > 0) & ((y & DELETED) > 0))


def groups(value: np.ndarray, node: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of one bucket's signatures as two arrays of nodes, and the rows that belong to large groups."""
    order = np.lexsort((node, value))
    value, node, role = value[order], node[order], role[order]
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(value)))
    a, b = [], []
    both = (np.bitwise_or.reduceat(role, start) & (INDEX | PROBE) == INDEX | PROBE) & (np.bitwise_and.reduceat(role, start) & DELETED == 0) if len(value) else np.zeros(0, bool)
    big = np.repeat((size > SMALL) & both, size)  # in other large groups nothing meets
    idle = np.repeat((size > SMALL) & ~both, size)
    place = np.arange(len(value)) - np.repeat(start, size)
    for step in range(1, SMALL):  # pairs of rows that lie ``step`` apart in a small group
        i = np.flatnonzero(~big & ~idle & (place >= step))
        if not len(i):
            break
        ok = may_match(role[i], role[i - step]) & (node[i] != node[i - step])
        a.append(node[i[ok] - step])
        b.append(node[i[ok]])
    i = np.flatnonzero(big & (place > 0))
    if len(i):
        head = np.repeat(start, size)[i]
        ok = may_match(role[i], role[head]) & (node[i] != node[head])
        a.append(node[head[ok]])
        b.append(node[i[ok]])
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(x) if x else none for x in (a, b))
    if len(a):
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        a, b = pair.T
    return a, b, order[big]


def sketches(sets: Sets) -> list[np.ndarray]:
    """For each set, parities of how many tokens hash to each bit: a power of two of bits, ``BITS`` or at least two for
    each token. Two sets of equally long sketches differ in at least as many tokens as their sketches differ in bits;
    a longer sketch whose halves are combined by exclusive or is the sketch of half the length."""
    level = np.ceil(np.log2(np.maximum(2 * sets.sizes, BITS) / BITS)).astype(np.int64)
    out: list = [None] * len(level)
    for k in np.unique(level):
        use, bits = np.flatnonzero(level == k), BITS << int(k)
        token = ragged(sets.first[use], sets.sizes[use])
        at = np.repeat(np.arange(len(use)), sets.sizes[use]) * bits + (C.mix(sets.hashes[token] + _OTHER) % np.uint64(bits)).astype(np.int64)
        odd = np.packbits((np.bincount(at, minlength=len(use) * bits) & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(len(use), -1)
        for i, row in zip(use.tolist(), odd, strict=True):
            out[i] = row
    return out


def set_table(docs: DataFrame, chunks: int, width: int) -> DataFrame:
    """(chunk, doc_id, n, node, sketch) of every document; node is the digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.text_buffer(batch.column(2))
            for lo, hi in C.pieces(off, 2 << 20):
                s = sets_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s.sizes.astype(np.int64)), pa.array(s.digest.view(np.int64)), pa.array(sketches(s), pa.list_(pa.int64()))], ["chunk", "doc_id", "n", "node", "sketch"])

    return C.with_chunks(docs, chunks).mapInArrow(run, "chunk int, doc_id long, n long, node long, sketch array<long>")


def may_be_alike(percent: int):
    """Whether the sizes and sketches of a and b allow them to be alike. Sets that may be alike in size have sketches
    of one length, or one is folded once; others pass. The first ``WORDS`` words of equally long sketches bound the
    difference from below and are compared in generated code, before all of it is."""
    xor = lambda x, y: x.bitwiseXOR(y)
    size = lambda x: F.size(f"sketch_{x}")

    def folded(x: str, other: str):
        half = (size(x) / 2).cast("int")
        sketch = F.col(f"sketch_{x}")
        return F.when(size(x) > size(other), F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), xor)).otherwise(sketch)

    a, b = folded("a", "b"), folded("b", "a")
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda t, x: t + x)
    far = (size("a") > size("b") * 2) | (size("b") > size("a") * 2)
    word = lambda x, k: F.get(f"sketch_{x}", F.lit(k))
    some = reduce(add, (F.coalesce(F.bit_count(xor(word("a", k), word("b", k))), F.lit(0)) for k in range(WORDS)))
    maybe = (size("a") != size("b")) | (some * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
    near = far | (maybe & (bits * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)))
    return F.when(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent, near).otherwise(False)


def described(nodes: DataFrame, side: str) -> DataFrame:
    """The nodes with all columns named for one side of a pair; the node itself is named as the side."""
    return nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "chunk", "doc_id", "sketch")))


def in_reach(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be alike."""
    return pairs.join(described(nodes, "a"), "a").join(described(nodes, "b"), "b").where(may_be_alike(percent)).select("a", "b")


def candidates(docs: DataFrame, width: int, scheme: Scheme, buckets: int) -> DataFrame:
    """Rows (a, b, value, role): pairs of nodes (value null), and members a of large groups."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        have: list = []
        nodes: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not have:
                return
            value, of, role = (np.concatenate(x) for x in zip(*have, strict=True))
            digest = np.concatenate(nodes)
            order = np.argsort(value, kind="stable")
            value, of, role = value[order], of[order], role[order]
            at, bounds = C.deal(C.bucket_of(value, buckets), buckets)
            short = ((value << np.uint64(buckets.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)
            which, lists = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                used, local = np.unique(of[a:b], return_inverse=True)
                lists.append(digest[used].tobytes())
                which.append(local.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x, pa.binary()) for x in (C.blobs(short, bounds), which, lists, C.blobs(role, bounds)))], ["bucket", "values", "which", "nodes", "roles"])
            have.clear()
            nodes.clear()
            seen.clear()  # what a later part sends again is merged in its bucket

        total = count = 0
        for batch in batches:
            data, off = C.text_buffer(batch.column(0))
            for lo, hi in C.pieces(off, 1 << 20):
                s = sets_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width)
                fresh = np.array([d not in seen and not seen.add(d) for d in s.digest.tolist()], bool) & (s.sizes > 0)
                keep = np.flatnonzero(fresh)
                token = ragged(s.first[keep], s.sizes[keep])
                s = Sets(s.hashes[token], np.append(0, np.cumsum(s.sizes[keep])), s.digest[keep])
                value, of, role = signatures(s, scheme)
                have.append((value, of + count, role))
                nodes.append(s.digest)
                total, count = total + len(value), count + len(keep)
                if total > 1_500_000:
                    yield from flush()
                    total = count = 0
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        value = np.concatenate(C.arrays(table["values"], np.uint32))
        node = np.concatenate([np.frombuffer(n, np.int64)[np.frombuffer(w, np.uint32)] for n, w in zip(table["nodes"].to_pylist(), table["which"].to_pylist(), strict=True)])
        role = np.concatenate(C.arrays(table["roles"], np.uint8))
        _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(count[inverse] > 1)
        value, node, role = value[keep].astype(np.int64), node[keep], role[keep]
        order = np.lexsort((role, node, value))  # a node that several tasks sent counts once
        new = np.ones(len(order), bool)
        new[1:] = np.diff(value[order]) != 0
        new[1:] |= (np.diff(node[order]) != 0) | (np.diff(role[order].astype(int)) != 0)
        value, node, role = value[order[new]], node[order[new]], role[order[new]]
        a, b, big = groups(value, node, role)
        bucket = table["bucket"][0].as_py()
        pad = pa.nulls(len(a), pa.int64())
        pairs = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pad, "role": pad.cast(pa.int32())})
        members = pa.table({"a": pa.array(node[big], pa.int64()), "b": pa.nulls(len(big), pa.int64()), "value": pa.array((np.int64(bucket) << 32) | value[big], pa.int64()), "role": pa.array(role[big].astype(np.int32))})
        return pa.concat_tables([pairs, members])

    sent = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(send, "bucket int, values binary, which binary, nodes binary, roles binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long, value long, role int")


def verified(docs: DataFrame, chunks: int, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are at least ``percent`` alike. ``nodes``: node, chunk and doc_id of one
    document that has the set. Only those documents are dealt while their list is short enough to broadcast."""
    places = nodes.select("node", "chunk", "doc_id")
    left, right = (places.select(F.col("node").alias(x), F.col("chunk").alias(f"chunk_{x}"), F.col("doc_id").alias(f"doc_{x}")) for x in "ab")
    pairs = fitted(pairs.join(left, "a").join(right, "b").checkpoint())
    asked = pairs.select(F.col("chunk_a").alias("chunk"), F.col("chunk_b").alias("to"), "a", "doc_a").distinct()
    dealt = C.with_chunks(docs, chunks)
    needed = pairs.select(F.col("chunk_a").alias("chunk"), F.col("doc_a").alias("doc_id")).unionAll(pairs.select("chunk_b", "doc_b")).distinct().checkpoint()
    if needed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dealt = dealt.join(F.broadcast(needed), ["chunk", "doc_id"], "left_semi")

    def chosen(table: pa.Table, doc_ids) -> tuple[Sets, dict[int, int]]:
        table = table.filter(pa.compute.is_in(table["doc_id"], value_set=doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids))
        s = sets_of(*C.text_buffer(table["text"]), width)
        return s, {d: k for k, d in enumerate(s.digest.view(np.int64).tolist())}

    def send(table: pa.Table, wanted: pa.Table) -> pa.Table:
        s, at = chosen(table, wanted["doc_a"])
        packed = {a: s.hashes[s.first[at[a]] : s.first[at[a] + 1]].tobytes() for a in set(wanted["a"].to_pylist())}
        return pa.table({"chunk": wanted["to"], "a": wanted["a"], "b": pa.nulls(len(wanted), pa.int64()), "doc_b": pa.nulls(len(wanted), pa.int64()), "set": pa.array([packed[a] for a in wanted["a"].to_pylist()], pa.binary())})

    def compare(table: pa.Table, got: pa.Table) -> pa.Table:
        is_set = pa.compute.is_null(got["b"])
        given, rows = got.filter(is_set), got.filter(pa.compute.invert(is_set))
        s, at = chosen(table, rows["doc_b"])
        h = s.hashes
        other = {a: np.frombuffer(raw, np.uint64) for a, raw in zip(given["a"].to_pylist(), given["set"].to_pylist(), strict=True)}
        keep = []
        for a, b in zip(rows["a"].to_pylist(), rows["b"].to_pylist(), strict=True):
            x, k = other[a], at[b]
            y = h[s.first[k] : s.first[k + 1]]
            small, large = (x, y) if len(x) < len(y) else (y, x)
            place = np.searchsorted(large, small)
            both = int(np.count_nonzero(large[np.minimum(place, len(large) - 1)] == small))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return rows.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    schema = "chunk int, a long, b long, doc_b long, set binary"
    given = dealt.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(send, schema)
    rows = pairs.select(F.col("chunk_b").alias("chunk"), "a", "b", "doc_b", F.lit(None).cast("binary").alias("set"))
    return dealt.groupBy("chunk").cogroup(given.unionAll(rows).groupBy("chunk")).applyInArrow(compare, "a long, b long")


def has(column: str, bit: int):
    """Whether a role has the bit."""
    return F.col(column).bitwiseAND(bit) > 0


def split_groups(members: DataFrame, tree: DataFrame) -> DataFrame:
    """Members (value, node, role, root) of the large groups that lie in several components and in which something
    probes: with the most frequent component (main), and whether members outside it or in it probe (out, inside)."""
    member = members.join(tree.withColumnRenamed("node", "a"), "a", "left").select("value", F.col("a").alias("node"), "role", F.coalesce("root", "a").alias("root"))
    by_root = member.groupBy("value", "root").agg(F.count("*").alias("c"), F.count_if(has("role", PROBE)).alias("probes"))
    most = F.struct("c", "root")
    split = by_root.groupBy("value").agg(F.count("*").alias("parts"), F.max_by("root", most).alias("main"), F.max_by("probes", most).alias("mine"), F.sum("probes").alias("probes"))
    split = split.where("parts > 1 and probes > 0").select("value", "main", F.expr("probes > mine").alias("out"), F.expr("mine > 0").alias("inside"))
    return member.join(split, "value")


def picked(member: DataFrame) -> DataFrame:
    """The members in ``PICKS`` groups of each node: those with the least hashes, so that nodes that share most of
    their groups pick the same one."""
    least = [F.min_by("value", F.xxhash64(F.lit(k), "value")) for k in range(PICKS)]
    picks = member.groupBy("node").agg(F.explode(F.array_distinct(F.array(*least))).alias("value"))
    return member.join(picks, ["node", "value"])


def pivot_pairs(member: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a group with its pivots that may be alike and are not connected yet: the members that come
    first by a hash, of those that probe and are indexed where there are any. No more than ``PIVOTS`` rows for each
    member."""
    whole = ~has("role", DELETED)
    order = lambda k: F.struct(F.col("role") != (INDEX | PROBE), F.xxhash64(F.lit(k), "node"))
    least = [F.min_by(F.struct("node", "role", "root"), order(k)) for k in range(PIVOTS)]
    pivots = member.where(whole).groupBy("value").agg(F.explode(F.array_distinct(F.array(*least))).alias("p"))
    pivots = pivots.select("value", F.col("p.node").alias("pivot"), F.col("p.role").alias("its_role"), F.col("p.root").alias("its_root"))
    meets = (has("role", PROBE) & has("its_role", INDEX)) | (has("role", INDEX) & has("its_role", PROBE))
    met = member.join(pivots, "value").where(meets & (F.col("root") != F.col("its_root")))
    pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    return in_reach(pairs, nodes, percent)


def blocks(member: DataFrame) -> DataFrame:
    """The members with the cells (value, i, j) of their group in which they take part. In every pair one node probes and
    one is whole, so the group's probing members, or its whole ones where they are fewer, ask all others: block i of those
    who ask meets block j of all. A member is sent once for each block of those who ask, and only those who ask also to
    each block of all; ``asks`` (-1: does not) and ``told`` are its own blocks."""
    probes, whole = has("role", PROBE), ~has("role", DELETED)
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    few = F.least(F.count_if(probes), F.count_if(whole))
    sizes = member.groupBy("value").agg(of(few).alias("p"), of(F.count("*")).alias("q"), (F.count_if(whole) < F.count_if(probes)).alias("by_whole"))
    asking = F.when(F.col("by_whole"), whole).otherwise(probes)
    member = member.join(sizes, "value").withColumns({
        "told": F.pmod(F.xxhash64("node"), F.col("q")).cast("int"),
        "asks": F.when(asking, F.pmod(F.xxhash64(F.lit("asks"), "node"), F.greatest("p", F.lit(1)))).otherwise(-1).cast("int"),
    })
    below = lambda n: F.sequence(F.lit(0), F.col(n))  # noqa: E731  # one more, so that none is possible
    hears = F.transform(F.filter(below("p"), lambda k: k < F.col("p")), lambda k: F.struct(k.alias("i"), F.col("told").alias("j")))
    others = F.filter(below("q"), lambda k: (F.col("asks") >= 0) & (k < F.col("q")) & (k != F.col("told")))
    cells = F.concat(hears, F.transform(others, lambda k: F.struct(F.col("asks").alias("i"), k.alias("j"))))
    return member.withColumn("cell", F.explode(cells)).select("value", "cell.i", "cell.j", "asks", "told", "node", "role", "root", (F.col("root") == F.col("main")).alias("in_main"))


def folded(sketch: np.ndarray) -> np.ndarray:
    """Rows of sketches of half the length."""
    half = sketch.shape[1] // 2
    return sketch[:, :half] ^ sketch[:, half:]


def alike(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one cell, all pairs (places of a row of block i of those who ask and of a row of block j of all) of
    different components that meet and whose sizes and sketches allow them to be alike."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    asks, told, role, root, n, main = (table[c].to_numpy() for c in ("asks", "told", "role", "root", "n", "in_main"))
    lists = table["sketch"].combine_chunks()
    bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
    words = np.diff(bounds)
    left, right = np.flatnonzero(asks == i), np.flatnonzero(told == j)
    right = right[np.argsort(n[right], kind="stable")]
    sides: dict[tuple[int, bool], tuple] = {}
    for w in np.unique(words[right]).tolist() if len(right) else []:
        at = right[words[right] == w]
        sketch = flat[(bounds[at][:, None] + np.arange(w))]
        for away in (False, True):  # all rows, and those outside the main component
            keep = ~main[at] if away else np.ones(len(at), bool)
            sides[w, away] = at[keep], n[at[keep]], sketch[keep], folded(sketch[keep]) if w > 1 else None
    xs, ys = [], []
    for x in left.tolist():
        w, size = int(words[x]), int(n[x])
        own = flat[bounds[x] : bounds[x + 1]]
        for (v, away), (at, sizes, sketch, half) in sides.items():
            if away != bool(main[x]):
                continue
            lo, hi = np.searchsorted(sizes, [-(-size * percent // 100), size * 100 // percent + 1])
            if lo == hi:
                continue
            if v == w:
                some, mine = sketch[lo:hi], own
            elif v == 2 * w:
                some, mine = half[lo:hi], own
            elif w == 2 * v:
                some, mine = sketch[lo:hi], folded(own[None])[0]
            else:
                xs.append(np.full(hi - lo, x))
                ys.append(at[lo:hi])
                continue
            room = (size + sizes[lo:hi]) * (100 - percent)
            keep = np.flatnonzero(np.bitwise_count(some[:, :WORDS] ^ mine[:WORDS]).sum(axis=1, dtype=np.int64) * (100 + percent) <= room)
            if len(mine) > WORDS and len(keep):
                rest = np.bitwise_count(some[keep] ^ mine).sum(axis=1, dtype=np.int64) * (100 + percent) <= room[keep]
                keep = keep[rest]
            if len(keep):
                xs.append(np.full(len(keep), x))
                ys.append(at[lo + keep])
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    ok = (root[x] != root[y]) & may_match(role[x], role[y])
    return x[ok], y[ok]


def few(node_a: np.ndarray, node_b: np.ndarray, root_a: np.ndarray, root_b: np.ndarray, turn: int) -> np.ndarray:
    """Places of the pairs that are among the first ``FEW`` of one of their components, by a hash of pair and turn."""
    pair = C.mix(C.mix(node_a.view(np.uint64) ^ np.uint64(turn)) + node_b.view(np.uint64))
    root, of = np.append(root_a, root_b), np.tile(np.arange(len(pair)), 2)
    order = np.lexsort((pair[of], root))
    start = np.flatnonzero(np.append(True, np.diff(root[order]) != 0))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return np.unique(of[order[rank < FEW]])


def open_pairs(member: DataFrame, nodes: DataFrame, percent: int, turn: int | None = None) -> DataFrame:
    """(a, b, cut): pairs in large groups that may be alike and are not connected yet; without ``turn`` all of them, else
    some of each component. ``cut``: the groups of those tasks that had more, each with a row at least."""

    def meet(table: pa.Table) -> pa.Table:
        x, y = alike(table, percent)
        node, root = table["node"].to_numpy(), table["root"].to_numpy()
        swap = node[x] > node[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pair, one = np.unique(np.stack([node[x], node[y]], axis=1), axis=0, return_index=True)
        x, y, cut = x[one], y[one], False
        if turn is not None and len(one):
            keep = few(pair[:, 0].copy(), pair[:, 1].copy(), root[x], root[y], turn)
            cut, pair = len(keep) < len(pair), pair[keep]
        value = pa.array(np.full(len(pair), table["value"][0].as_py()), pa.int64(), mask=np.full(len(pair), not cut))
        return pa.table({"a": pa.array(pair[:, 0]), "b": pa.array(pair[:, 1]), "cut": value})

    rows = blocks(member).join(nodes.select("node", "n", "sketch"), "node")
    return rows.groupBy("value", "i", "j").applyInArrow(meet, "a long, b long, cut long").groupBy("a", "b").agg(F.collect_set("cut").alias("cut"))


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the smallest doc_id that it is linked to."""
    checkpoint_dir(docs.sparkSession)
    release(docs.sparkSession)
    plan = C.layout(docs, chunk_bytes, bucket_bytes=32 << 20)
    table = set_table(docs, plan.chunks, width).checkpoint()
    nodes = table.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "chunk", "n", "sketch")).alias("one")).select("node", "one.*").checkpoint()
    nodes = fitted(nodes)
    # sizes of sets come to the driver as counts by band of 1/64 of their power of two at most
    size_key = F.when(F.col("n") < 128, F.col("n")).otherwise(F.floor(F.col("n") / F.pow(F.lit(2), F.floor(F.log2("n")) - 6)) * F.pow(F.lit(2), F.floor(F.log2("n")) - 6)).cast("long")
    counts = nodes.groupBy(size_key.alias("size")).agg(F.count("*").alias("c"), F.max("n").alias("most")).collect()
    sizes = np.array([*(r["size"] for r in counts), max((r["most"] for r in counts), default=1)], np.int64)
    scheme = scheme_for(percent, sizes, np.array([*(r["c"] for r in counts), 0], np.int64))
    found = fitted(candidates(docs, width, scheme, plan.buckets).checkpoint())
    pairs = found.where("value is null").select("a", "b").distinct()
    release(docs.sparkSession)
    links = verified(docs, plan.chunks, nodes, in_reach(pairs, nodes, percent), width, percent).checkpoint()
    release(docs.sparkSession)
    tree = fitted(roots(links).checkpoint())
    members = found.where("value is not null")
    rounds = [] if members.isEmpty() else ["pivots", *range(FEW_ROUNDS), None]
    for turn in rounds:
        release(docs.sparkSession)
        member = fitted(split_groups(members, tree).checkpoint())
        if turn == "pivots":
            more = pivot_pairs(picked(member), nodes, percent)
        else:
            more = open_pairs(member, nodes, percent, turn)
        more = fitted(more.checkpoint())
        if not more.isEmpty():
            links = verified(docs, plan.chunks, nodes, more.select("a", "b"), width, percent)
            tree = fitted(roots(tree.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links)).checkpoint())
        if turn != "pivots":
            cut = more.select(F.explode("cut").alias("value")).distinct()
            if cut.isEmpty():
                break  # all open pairs have been looked at
            members = members.join(cut, "value", "left_semi")
    joined = table.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least, "root", "left").select(
        C.plain_id().alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, C.plain_id("component_id")).otherwise(C.plain_id()).alias("component_id"),
    )


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Sets of four-word shingles at least 85 percent alike, over all documents."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


_WORD = r"[^\x20\x09-\x0D]+"
OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle FROM w, unnest(range(1, greatest(len(words) - 2, 2))) t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)"""
