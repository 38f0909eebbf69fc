"""The training-data operators against brute force, on planted cases, edge cases and a given table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import bpe, classlm, jaccard, langid, lines, mixing, neighbours, spotsigs, substring, suffixes
from ledgerloom.llm import components as components_of
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string"


@pytest.fixture(scope="module")
def planted(spark):
    """Nulls, empties, ties, repeated rows, long texts, near copies, and columns with clashing names."""
    rng = random.Random(7)
    words = [rng.choice("abcdefgh") + rng.choice("ijklm") + rng.choice("nop") for _ in range(400)]
    passage = " ".join(rng.choices(words, k=70))
    out = []
    for i in range(120):
        body = rng.choices(words, k=rng.randint(1, 160))
        text = " ".join(body)
        if i % 3 == 0:
            text = text + "\n" + passage + " " + " ".join(rng.choices(words, k=5))
        if i % 5 == 0 and i:
            old = out[rng.randrange(len(out))][1]
            text = (old or "") + ("" if i % 2 else " Extra")
        if i % 7 == 0:
            text = "one line here\nsecond line\nthird line\n" + text
        out.append((i, text, rng.choice(["en", "fr"]), rng.choice(["s1", "s2", None]), None, "x", "y"))
    out += [(200, None, None, None, None, "x", "y"), (201, "", "en", "s1", 0, "x", "y"), (202, " \n\t ", None, None, None, None, None), (203, "-" * 5000, "en", "s2", None, "x", "y"), (204, "é" * 80 + "\0" * 60, "fr", "s2", None, "x", "y"), (205, "wörd " * 6000, "fr", "s1", None, "x", "y")]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def texts(planted):
    return {r["doc_id"]: r["text"] or "" for r in planted.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def nothing(planted):
    return planted.limit(0)


def odd(spark):
    """A null id, and a row that is there twice."""
    return spark.createDataFrame([(1, "a b c d", "en", "s", 1, "", ""), (1, "a b c d", "en", "s", 1, "", ""), (None, "a b c d", "en", None, 1, "", ""), (None, None, None, None, None, None, None)], SCHEMA)


def cover(text, width, first, doc):
    keep = [True] * len(text)
    for i in range(len(text) - width + 1):
        if first[text[i : i + width]] < doc:
            keep[i : i + width] = [False] * width
    return keep


def firsts(texts, width):
    out = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - width + 1):
            out.setdefault(texts[d][i : i + width], d)
    return out


def test_substring(spark, planted, texts, nothing):
    w = {d: tuple(WORD.findall(t)) for d, t in texts.items()}
    first = firsts(w, 50)
    got = {r[0]: tuple(r[1:]) for r in substring.remove_repeated_words(planted).collect()}
    removed = 0
    for d, x in w.items():
        keep = cover(x, 50, first, d)
        removed += keep.count(False)
        assert got[d] == (len(x), keep.count(False), " ".join(a for a, b in zip(x, keep, strict=True) if b))
    assert removed > 500 and substring.remove_repeated_words(nothing).count() == 0
    assert substring.remove_repeated_words(odd(spark)).count() == 4


def test_difference_covers():
    for period, cover_set in substring.COVERS.items():
        assert {(a - b) % period for a in cover_set for b in cover_set} == set(range(period))


def test_suffixes(spark, planted, texts, nothing):
    raw = {d: t.encode() for d, t in texts.items()}
    first = firsts(raw, 50)
    got = {r[0]: tuple(r[1:]) for r in suffixes.remove_repeated_bytes(planted).collect()}
    for d, x in raw.items():
        keep = cover(x, 50, first, d)
        kept = bytes(a for a, b in zip(x, keep, strict=True) if b)
        assert got[d] == (len(x), keep.count(False), len(re.findall("0+", "".join("01"[k] for k in keep))), kept)
    assert suffixes.remove_repeated_bytes(nothing).count() == 0 and suffixes.remove_repeated_bytes(odd(spark)).count() == 4


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    got = suffixes.suffix_array(data, np.array([0]), np.array([3000]), np.array([3000]), np.array([True]), 50)
    raw = data.tobytes()
    assert [raw[i : i + 50] for i in got] == sorted(raw[i : i + 50] for i in range(3000))


def components(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    root = {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, planted, texts, nothing, width, percent):
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_components(planted, width, percent).collect()}
    want = components(texts, width, percent)
    assert got == want and sum(d != r for d, (_, r) in want.items()) > 3
    if width == 4:
        assert jaccard.near_components(nothing, width, percent).count() == 0
        assert {(r[0], r[2]) for r in jaccard.near_components(odd(spark), width, percent).collect()} == {(1, 1), (None, 1), (None, None)}


def test_jaccard_large_groups(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        b = list(base)
        for _ in range(rng.randint(0, 5)):
            b[rng.randrange(len(b))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(b)))
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == components(dict(rows), 4, 85)


def without_lines(texts):
    """Lines, lines removed and what is left of each text, in plain Python."""
    seen, want = set(), {}
    for d in sorted(texts):
        x = texts[d].split("\n")
        gone = set()
        for i in range(len(x) - 2):
            key = tuple(x[i : i + 3])
            if key in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(key)
        want[d] = (len(x), len(gone), "\n".join(v for i, v in enumerate(x) if i not in gone))
    return want


def test_line_dedup(spark, planted, texts, nothing):
    want = without_lines(texts)
    got = lines.dedup_lines(planted)
    assert got.columns == [*planted.columns, "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in got.collect()} == want
    assert lines.dedup_lines(nothing).count() == 0 and lines.dedup_lines(odd(spark)).count() == 4


def test_clashing_columns(spark, planted):
    """Columns with the names that operators use inside stay as they are, or are replaced where the docstring says so."""
    more = {c: F.lit("own") for c in ("__id", "__key", "__lines", "__cut", "__row", "__left", "n_lines", "h0")}
    got = lines.dedup_lines(planted.withColumns(more))
    kept = [c for c in more if c != "n_lines"]
    assert {tuple(r[c] for c in kept) for r in got.collect()} == {("own",) * len(kept)} and got.where("n_lines < 1").count() == 0
    sized = mixing.with_sizes(planted).withColumns({c: F.lit(1) for c in ("target", "n_docs", "source_size", "v", "a", "rest")})
    assert sorted(map(repr, mixing.mix_sources(sized).collect())) == sorted(map(repr, mixing.mix_sources(mixing.with_sizes(planted)).collect()))
    told = langid.predict(planted.withColumns({c: F.lit("own") for c in ("lang_pred", "score", "p")}), None)
    assert {(r["lang_pred"], r["score"], r["p"]) for r in told.collect()} == {("und", 0.0, "own")}


def test_spotsigs_values(spark, planted):
    """Likeness values against sets in plain Python."""
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(planted).select("doc_id", "sigs", "edited_sigs", "next_sigs", spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near"), spotsigs.fingerprint(F.col("sigs")).alias("print")).collect()}
    for r in got.values():
        a, b = set(r["sigs"]), set(r["edited_sigs"])
        want = 1.0 if not a | b else len(a & b) / len(a | b) if a and b else 0.0
        assert math.isclose(r["near"], want) and r["print"] == " ".join(f"{x & (1 << 64) - 1:016x}" for x in r["sigs"]) and r["sigs"] == sorted(a)


def test_mixing(spark, planted, nothing):
    got = mixing.mix_sources(mixing.with_sizes(planted)).collect()
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s, (size, target) in {r["source"]: (r["source_size"], r["target"]) for r in got}.items():
        assert target <= 2 * size and abs(taken[s] - target) <= max(x["size"] for x in got if x["source"] == s) / 2 + 1
    assert math.isclose(sum({r["source"]: r["target"] for r in got}.values()), 1.5 * sum(r["size"] for r in got))
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(mixing.with_sizes(planted)).collect()))
    assert mixing.mix_sources(mixing.with_sizes(nothing)).count() == 0 and mixing.mix_sources(mixing.with_sizes(odd(spark))).count() == 4


def test_bpe(spark, planted, texts, nothing):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    cases = list(texts.values()) + ["<|endoftext|> a<|endoftext|>"] + ["".join(rng.choice("ab 'sdlrevtm1é\n\t\x1c\x85\xa0中.") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    enc = bpe.Encoder(path)
    for t in cases:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), np.int32).tolist() == ids
        assert enc.decode(np.array(ids, np.int64), np.array([len(ids)])) == [library.decode(ids, skip_special_tokens=False)]
    got = bpe.bpe_round_trip(planted, path).collect()
    assert all(r["decoded"] == texts[r["doc_id"]] for r in got) and len(got) == len(texts)
    assert bpe.bpe_round_trip(nothing, path).count() == 0 and bpe.bpe_round_trip(odd(spark), path).count() == 4


def test_class_lm(spark, planted, texts, nothing):
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    tokens = {d: [*WORD.findall(t.translate(LOWER)), None] for d, t in texts.items()}
    counts = collections.Counter(x for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 10 for x in t)
    total, kinds = sum(counts.values()), len(counts)
    for r in classlm.score(planted, train).collect():
        t = tokens[r["doc_id"]]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[x] > 0 for x in t), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] <= 0
    assert classlm.score(nothing, train).count() == 0 and classlm.score(odd(spark), train).count() == 4


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 9, (21, 21)) * (rng.random((21, 21)) < 0.4)

    def likelihood(cls):
        member = np.eye(3)[cls]
        g = member.T @ a @ member
        f = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
        return f(g) - f(g.sum(axis=0)) - f(g.sum(axis=1))

    cls = classlm.exchange(a, classes=3, rounds=50)
    best = likelihood(cls)
    for w in range(20):
        for k in (1, 2):
            moved = cls.copy()
            moved[w] = k
            assert likelihood(moved) <= best + 1e-6
    assert cls[20] == 0 and set(cls[:20]) <= {1, 2}


def test_language_id(spark, sf, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = QUERIES["op4_language_id"](spark, sf).collect()
    right = [held[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]
    assert sum(right) >= 0.97 * len(right) and all(0 <= r["score"] <= 1 for r in got)
    model = langid.fit(docs, sample_docs=80)
    odd_rows = {r["text"]: r for r in langid.predict(spark.createDataFrame([(None, None), (1, ""), (2, "123 !"), (3, "x" * 50_000)], "doc_id long, text string"), model).collect()}
    assert all(odd_rows[t]["lang_pred"] == "und" and odd_rows[t]["rejected"] for t in (None, "", "123 !"))
    assert langid.fit(nothing) is None and langid.predict(nothing, None).count() == 0


def test_language_id_without_ids(spark):
    """The sample is chosen by the text where ids are null, and equal rows count once."""
    rows = [(None, f"the house number {i} is here", "en") for i in range(1000)] + [(None, f"la maison {i} est la bas", "fr") for i in range(1000)] + [(None, "the same text again", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, 200).collect()
    assert 100 < len(got) < 300 and len({r["text"] for r in got}) == len(got) and {r["lang"] for r in got} == {"en", "fr"}
    told = langid.predict(docs, langid.fit(docs, sample_docs=200))
    assert told.where("lang_pred = lang").count() > 0.9 * len(rows) and told.where("rejected").count() < 0.2 * len(rows)


def test_spotsigs(spark, planted, nothing, sf):
    for docs in (planted, spark.read.parquet(f"{sf}/documents.parquet")):
        got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(docs).collect()}
        text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
        ids = sorted(text)
        for i, d in enumerate(ids):
            x, y = text[d], text[ids[(i + 1) % len(ids)]]
            k = len(x) // 4
            assert got[d]["n_chars"] == len(x) and got[d]["edited"] == x[: len(x) - k] + y[:k]
            assert got[d]["next_sigs"] == got[ids[(i + 1) % len(ids)]]["sigs"]
    assert spotsigs.edited_fingerprints(nothing).count() == 0 and spotsigs.edited_fingerprints(odd(spark)).count() == 4
    prints = docs.select(spotsigs.signatures(F.col("text")).alias("sigs")).distinct().select("sigs", spotsigs.fingerprint(F.col("sigs")).alias("fp"))
    sets = {r["fp"]: set(r["sigs"]) for r in prints.collect() if r["sigs"]}
    want = {tuple(sorted((a, b), key=lambda x: (len(sets[x]), x))) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["left"], r["right"]) for r in spotsigs.near_duplicates(prints).collect()} == want


def test_neighbours(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    hit = total = 0
    found = collections.defaultdict(list)
    for r in QUERIES["op2_neighbours"](spark, sf).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"]))
        assert math.isclose(r["score"], float((v[r["query_id"]] * v[r["vec_id"]]).sum()), abs_tol=1e-12)
    for q in (x for x in v if x % 20 == 0):
        best = sorted((-float((v[q] * x).sum()), i) for i, x in v.items() if i != q)[:20]
        hit += len({i for _, i in best} & {i for _, i in found[q]})
        total += 20
    assert hit >= 0.9 * total
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, 0.5]), (None, [1.0, 0.0])]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(few, few.where("vec_id % 4 = 0"), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 2), (8, 1, 0), (8, 2, 1)]
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Rows that are there many times are one candidate; ties go to smaller ids, and no candidate is lost to them."""
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.0])] * 30 + [(2, [1.0, 0.0])] + [(8, [0.5, 0.5])]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = few.where("vec_id = 0")
    for k in (2, 3, 20):
        got = neighbours.nearest(few, asked, k).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 8)][:k]


def test_neighbours_in_many_blocks(spark, monkeypatch):
    """50,000 rows in hundreds of blocks, some of one hot cell: recall of the 20 nearest."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    x = centres[np.minimum(rng.geometric(0.3, 50_000) - 1, 39)] + 0.5 * rng.normal(size=(50_000, 16))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in neighbours.nearest(df, df.where("vec_id % 1000 = 0")).collect():
        found[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, 50_000, 1000):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-score, kind="stable")[:20].tolist()))
    assert len(found) == 50 and hit >= 0.9 * 1000


def test_neighbours_verify_less_than_half():
    """One block of 20,000 points in 16 clusters: recall and the share of points that are verified."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 64))
    x = centres[rng.integers(0, 16, 20_000)] + 0.6 * rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space = neighbours.Space(1.0, rng.normal(size=(65, neighbours.DIMS)), np.zeros(0, np.int64), np.zeros(0))
    block = neighbours.Block(space, x, [[i] for i in range(len(x))], 20)
    sure, hit = neighbours.chi_square_quantile(neighbours.SURE, neighbours.DIMS), 0
    for q in range(0, 20_000, 400):
        p = space.project_query(x[q : q + 1])
        far = neighbours.box_distance(p, block.low, block.high)[0]
        places, exact, _ = block.search(x[q], p[0], far, np.inf, sure)
        found = block.order[places[np.argsort(-exact, kind="stable")][:20]]
        hit += len(set(found.tolist()) & set(np.argsort(-(x @ x[q]), kind="stable")[:20].tolist()))
    assert hit >= 0.9 * 50 * 20 and block.verified < 0.5 * 50 * len(x)


def test_chi_square():
    assert math.isclose(neighbours.chi_square_quantile(0.95, 8), 15.507, abs_tol=1e-3)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pipeline(spark, sf, nothing):
    """Each stage against plain Python on the stage's own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        before = [r.asDict() for r in docs.collect()]
        after = [r.asDict() for r in got.collect()]
        if name == "language_id":
            told = langid.predict(docs, langid.fit(docs)).where("not rejected").collect()
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in told) and len(after) >= 0.97 * len(before)
            same = {r["doc_id"]: r["lang_pred"] for r in told}
            assert sum(same[r["doc_id"]] == r["lang"] for r in after) >= 0.97 * len(after)
        elif name == "line_dedup":
            want = without_lines({r["doc_id"]: r["text"] for r in before})
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {d: (t, len(t)) for d, (_, _, t) in want.items()} and any(n for _, n, _ in want.values())
        elif name == "near_duplicates":
            want = components({r["doc_id"]: r["text"] for r in before}, 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted(d for d, (_, c) in want.items() if d == c)
        elif name == "mix":
            size = lambda rows: sum(len(WORD.findall(r["text"])) for r in rows)
            assert abs(size(after) - 1.5 * size(before)) <= 0.1 * size(before)
        if name != "encode":
            assert got.columns == corpus_pipeline.COLUMNS
            got.write.mode("overwrite").parquet(f"{corpus_pipeline.checkpoint_dir(spark)}/test-{name}")
            docs = spark.read.parquet(f"{corpus_pipeline.checkpoint_dir(spark)}/test-{name}")
        else:
            text = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before) and all(r["decoded_sha256"] == sha(text[r["doc_id"]]) for r in after)
            whole = corpus_pipeline.run(spark, sf)
            assert sorted(map(repr, whole.collect())) == sorted(map(repr, got.collect()))
        assert stage(spark, nothing.select(corpus_pipeline.COLUMNS), sf).count() == 0


def test_pipeline_rows_with_null_and_shared_ids(spark, sf):
    rng = random.Random(11)
    text = lambda n=60: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    copied, near, clean, twice, lone = (text() for _ in range(5))
    rows = [(1, near), (9, near + " end"), (9, clean), (None, copied), (None, copied + " end"), (None, copied), (5, twice), (5, twice), (None, lone), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()]
    assert len(got) == 7 and {(1, near), (9, clean), (5, twice), (None, lone), (None, None)} <= set(got)
    assert sum(t in (copied, copied + " end") for _, t in got) == 1
    rows = [(None if i % 3 else 7, text(rng.randint(5, 60)), "en", "abc"[i % 3], 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r["source"]: r["target"] for r in mixing.source_targets(mixing.with_sizes(docs)).collect()}
    taken, copies = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.mix(spark, docs, sf).collect():
        taken[r["source"]] += len(r["text"].split())
        copies[r["text"]] += 1
    assert all(abs(taken[s] - t) <= 31 for s, t in target.items()) and max(copies.values()) <= 2


@pytest.mark.parametrize("tail", [b"\n", b"", b"z"])
def test_suffix_runs_of_one_byte_stay_linear(tail):
    for stretch in (b"x" * 20_000, b"xy-" * 7_000):
        data, off = np.frombuffer(b"start " + stretch + tail, np.uint8), np.array([0, 6 + len(stretch) + len(tail)])
        sent = suffixes.Sent(data, off, np.array([1]), suffixes.Runs(data, off, 50, suffixes.ANCHOR), 50, 32)
        assert (sent.stop - sent.start).sum() < 20 * len(data)


def test_suffixes_of_long_rules(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    rows = [(i, f"{word()} " * 3 + c * (3000 + 7 * i) + end + word()) for i, (c, end) in enumerate([("-", "\n"), ("-", "\n"), ("-", "a"), ("zy", "\n"), ("zy", ""), ("-", ""), ("z", "\n" * 80)])]
    raw = {d: t.encode() for d, t in rows}
    first = firsts(raw, 50)
    for r in suffixes.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        x = raw[r["doc_id"]]
        assert r["kept"] == bytes(a for a, b in zip(x, cover(x, 50, first, r["doc_id"]), strict=True) if b)


def test_suffixes_split_hot_anchors(spark, planted, texts):
    rng = random.Random(9)
    part = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    short, long = part(40), part(300)
    rows = [(i, part(60) + short + part(60) + (long + part(30) if i % 3 else "")) for i in range(200)]
    for docs, raw in ((spark.createDataFrame(rows, "doc_id long, text string"), {d: t.encode() for d, t in rows}), (planted, {d: t.encode() for d, t in texts.items()})):
        first = firsts(raw, 50)
        for r in suffixes.remove_repeated_bytes(docs, chunk_bytes=4096, hot=8).collect():
            x = raw[r["doc_id"]]
            assert r["kept"] == bytes(a for a, b in zip(x, cover(x, 50, first, r["doc_id"]), strict=True) if b)


def test_windows_of_hot_anchors_spread_over_buckets():
    rng = np.random.default_rng(3)
    short = rng.integers(97, 123, 40).astype(np.uint8)
    data = np.concatenate([np.concatenate([rng.integers(97, 123, 100), short, rng.integers(97, 123, 100)]) for _ in range(2000)]).astype(np.uint8)
    off = np.arange(2001) * 240
    runs = suffixes.Runs(data, off, 50, suffixes.ANCHOR)
    u, count = np.unique(runs.anchor, return_counts=True)
    assert count.max() > 500
    runs.split(data, np.isin(runs.anchor, u[count > 100]), 50)
    sent = suffixes.Sent(data, off, np.arange(2000), runs, 50, 32)
    assert np.bincount(sent.bucket, sent.stop - sent.start).max() < 2 * (sent.stop - sent.start).sum() / 32
    assert (sent.stop - sent.start).max() < 400


def test_class_lm_places_every_word_by_its_contexts(spark):
    """Words of two kinds with one ending, too many to be units of their own: contexts tell the kinds apart."""
    rng = random.Random(2)
    kinds = [[f"{k}{i}xyz" for i in range(700)] for k in "ab"]
    rows = [(i, " ".join(x for _ in range(20) for k in (0, 1) for x in (("the", "of")[k], rng.choice(kinds[k])))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in classlm.score(docs.unionByName(spark.createDataFrame([(1000 + k, f"the {a} of {b}") for k, (a, b) in enumerate([(kinds[0][650], kinds[1][650]), (kinds[1][650], kinds[0][650])])], docs.schema)), F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001] + 1
    assert classlm.parts_for(10**8) > classlm.parts_for(10**6) > classlm.parts_for(10**3) == 1


def test_roots_are_complete_or_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {r["root"] for r in components_of.roots(path).collect()} == {0} == {r["root"] for r in components_of.roots(path, one_task=0).collect()}
    with pytest.raises(RuntimeError):
        components_of.roots(path, most_rounds=1, one_task=0)
    rng = random.Random(4)
    links = spark.createDataFrame([(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(160)], "a long, b long")
    one, rounds = (sorted(map(tuple, components_of.roots(links, one_task=n).collect())) for n in (components_of.ONE_TASK, 0))
    assert one == rounds and len(one) > 100 and components_of.roots(links.limit(0)).count() == 0
