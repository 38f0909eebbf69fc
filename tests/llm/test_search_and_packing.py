"""Lexical search, hard negatives and packing against brute force and the tokenizer library, with edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import lexical, negatives, packing, terms
from ledgerloom.llm.bpe import vocabulary_path
from ledgerloom.llm.chunks import text_buffer
from ledgerloom.llm.wordids import WordIds

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, n long, bag string, ids string, m long, term string"
WORDS = ["alpha", "Beta", "gámma", "delta-eps", "漢字", "a_very_long_word_of_many_bytes", "x1", "İz", "and", "the"]


@pytest.fixture(scope="module")
def planted(spark):
    """Copies, ties, repeated rows, nulls, empty and long texts, and columns with names that operators use inside."""
    rng = random.Random(3)
    out = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))) for i in range(150)]
    out += [(1000 + i, "alpha and beta, the alpha") for i in range(60)]  # a class of more members than any rank
    out += [(7, out[7][1]), (None, "alpha and beta, the alpha"), (None, None), (400, None), (401, ""), (402, " ,;\0 "), (403, "alpha " * 30_000), (404, "漢字" * 9000 + " alpha"), (405, "<|endoftext|> don't <|startoftext|>x")]
    return spark.createDataFrame([(*r, 1, "own", "own", 2, "own") for r in out], SCHEMA)


def brute_ranks(docs, items, k=20):
    cut = lambda t: re.findall(lexical.TERM, (t or "").translate(LOWER))
    bags = [(d, collections.Counter(cut(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(x for *_, x in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b, x in bags:
            m = 75 + 25 * x * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in cut(text) if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return out


def test_lexical_search(spark, planted, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in planted.collect()]
    asked = [(1, "Alpha BETA alpha"), (2, "漢字 gámma! unknown"), (3, ""), (4, None), (5, "unknown"), (1, "delta x1 a_very_long_word_of_many_bytes"), (None, "the and"), (6, "long very word bytes " * 300)]
    items = spark.createDataFrame([(*r, "own") for r in asked], "item_id long, text string, doc_id string")
    rows = lambda df: sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    want = sorted(brute_ranks(docs, asked), key=repr)
    assert rows(lexical.ranked(planted, items)) == want and len(want) > 80
    monkeypatch.setattr(lexical, "SLICE_BYTES", 40)  # several slices of items
    monkeypatch.setattr(lexical, "ENTRIES", 8)
    assert rows(lexical.ranked(planted.repartition(7), items)) == want
    assert lexical.ranked(planted.limit(0), items).count() == 0 and lexical.ranked(planted, items.limit(0)).count() == 0
    assert lexical.ranked(planted.where("text is null"), items).count() == 0


def test_classes_of_equal_bags_are_scored_once(spark, planted):
    vocabulary = {b"alpha": 0, b"beta": 1}
    table = lexical.bags(planted.repartition(5), vocabulary)
    got = [r["ids"] for r in lexical.classes(table, 100, 1000, 20).collect()]
    hot = [x for x in got if 1000 in x]
    assert hot == [list(range(1000, 1020))] and sum(r["rows"] for r in table.collect()) == planted.count()


def test_lookup_is_exact():
    known = {w.encode(): i for i, w in enumerate(["a", "ab", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 8, "a\0"])}
    text = " ".join(["a", "ab", "abc", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "abcdefghijklmnopr", "é" * 8, "a\0", "a\0\0"])
    inside = np.ones(256, bool)
    inside[0x20] = False
    data, offsets = text_buffer(pa.array([text, "", "a"]))
    found = terms.runs(data, offsets, inside)
    assert terms.Lookup(known).find(data, found.start, found.end).tolist() == [known.get(w.encode(), -1) for w in [*text.split(" "), "a"]]
    assert found.doc.tolist() == [0] * 11 + [2]


def brute_negatives(rows, anchor, label):
    rows = [(i, label(i, k), [math.floor(256 * x) for x in v]) for i, v, k in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for *_, v in rows), default=0)
    rows = [(i, k, v + [0] * (dim - len(v))) for i, k, v in rows]
    out, done = [], set()
    for a, ka, va in rows:
        if a is None or not anchor(a) or (a, ka, tuple(va)) in done:
            continue
        done.add((a, ka, tuple(va)))
        every = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i is None, i or 0, k, i) for i, k, v in rows if i != a)
        for s, *_, p in [x for x in every if x[3] == ka][:5]:
            fits = [x for x in every if x[3] != ka and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out += [(a, p, r + 1, x[4], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("scale", "dim", "fields"), [(0.1, 8, 3), (0.5, 8, 2), (40.0, 16, 1)])
def test_hard_negatives(spark, monkeypatch, scale, dim, fields):
    """Wider values leave fewer fields in a word; blocks and slices are small here."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, dim))
    x = (centres[rng.integers(0, 4, 300)] + rng.normal(size=(300, dim))) * scale
    rows = [(i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(300 + i, rows[10][1], i % 2) for i in range(40)]  # one vector, many times
    rows += [(50, rows[50][1], rows[50][2]), (100, rows[3][1], 1), (500, None, 1), (501, rows[1][1], None), (502, [1.0, None], 1), (550, [float("nan")] * dim, 1), (503, [float("inf")] * dim, 1), (600, [], 1), (650, [scale], 2), (None, rows[0][1], 2)]
    table = spark.createDataFrame([(*r, "own", "own") for r in rows], "vec_id long, embedding array<float>, label int, id string, block string")
    largest = max(abs(math.floor(256 * c)) for _, v, k in rows if v and k is not None and all(c is not None and math.isfinite(c) for c in v) for c in v)
    assert negatives.Packing(largest, dim).fields == fields
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 60)
    monkeypatch.setattr(negatives, "SLICE_ANCHORS", 3)
    monkeypatch.setattr(negatives, "AT_ONCE", 2)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(table, F.col("id") % 50 == 0, label)
    want = brute_negatives(rows, lambda i: i % 50 == 0, lambda i, k: (k + 1) % 10 if i is not None and i % 7 == 0 else k)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 40
    assert negatives.hard_negatives(table.limit(0), F.col("id") % 50 == 0).count() == 0


def test_too_wide_values_are_refused(spark):
    wide = spark.createDataFrame([(0, [1e9, 1e9], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="bits"):
        negatives.hard_negatives(wide, F.col("id") % 50 == 0)


def test_packed_fields_are_exact():
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-256, 257, (101, 64)), rng.integers(-256, 257, (7, 64))
    rows[0], anchors[0] = 256, 256
    rows[1], anchors[1] = -256, 256
    p = negatives.Packing(256, 64)
    assert p.fields == 2 and (p.scores(p.packed(rows), rows, anchors) == anchors @ rows.T).all()


def test_word_ids_are_those_of_the_library(planted):
    path = vocabulary_path("word_bpe_49k.json")
    texts = [r["text"] or "" for r in planted.collect()] + ["é ́ x", "ΣΑΣ  ﬁ ½ Ω​", "a<|endoftext|>b c", "'s 'll it's 1234", "\x1c\x85 y"]
    rng = random.Random(9)
    texts += ["".join(rng.choices("aZs't.,-=<|>1é€\u0338\u0301 %<|endoftext|>", k=30)) for _ in range(2000)] + ["it's.'s-'s", "a='s", "x<|endoftext|>.", "a\u0301.b\u0338=\u0338"]
    library, own = Tokenizer.from_file(path), WordIds(path)
    for _ in range(2):  # the second time from the table
        data, offsets = text_buffer(pa.array(texts))
        ids, counts = own.encode(data, offsets)
        ends = np.append(0, np.cumsum(counts))
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def pieces_hold_all(rows, want, size):
    """Every id in one piece, sequences without gaps, of ``size`` tokens or a power of two."""
    whole, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], len(ids)))
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at == size or (at < size and at & (at - 1) == 0)
    assert collections.Counter({k: sum(len(x) for _, x in v) for k, v in whole.items()}) == collections.Counter([(d, len(x)) for d, x in want for _ in range(len(x))])
    for d, x in want:
        assert any(x[a : a + len(p)] == p for a, p in whole[d, len(x)])
    return [sum(n for _, n in v) for v in sequences.values()]


@pytest.mark.parametrize("held", [2 << 20, 300])
def test_packing(spark, planted, monkeypatch, held):
    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "SHARD_TOKENS", held)
    monkeypatch.setattr(packing, "PART_BYTES", 5000)
    for size in (64, 4096):
        rows = packing.pack(planted, path, size).collect()
        want = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in planted.select("doc_id", "text").collect()]
        lengths = pieces_hold_all(rows, want, size)
        assert sum(lengths) == sum(len(x) for _, x in want)
    assert packing.pack(planted.limit(0), path).count() == 0


def test_seed_documents_get_their_neighbours():
    """A seed's sequence is filled by the documents that share its rare tokens, and the last one is cut."""
    ids = [np.array(x, np.uint32) for x in ([1, 2, 3], [9, 8, 9], [1, 2, 4, 5], [7, 7], [3, 9])]
    idf = np.full(16, 2.0)
    idf[3] = 0.1
    got = list(packing.Shard(ids, idf, 3.0).sequences(6))
    assert got == [[(0, 0, 3), (2, 0, 3)], [(1, 0, 3), (4, 0, 2), (2, 3, 1)]]


def test_packing_query(spark, sf):
    path = vocabulary_path("word_bpe_49k.json")
    got = packing.op13_packing(spark, sf).collect()
    library = Tokenizer.from_file(path)
    docs = {r["doc_id"]: np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got:
        assert zlib.crc32(docs[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(docs[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(map(len, docs.values()))
