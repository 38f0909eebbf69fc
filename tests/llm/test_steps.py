"""Steps of the operators alone: their results by definition, and the memory that they take."""

import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm import suffixes


def peak_bytes(f, *args):
    tracemalloc.start()
    try:
        got = f(*args)
        return got, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("letters", [b"ab", b"abcdefghij ", b"a"])
def test_reach_by_definition(letters):
    data = np.frombuffer(letters, np.uint8)[np.random.default_rng(5).integers(0, len(letters), 600)]
    offsets = np.array([0, 0, 170, 171, 600])
    runs = suffixes.Runs(data, offsets, 20, 8)
    to, at_end = suffixes.reach(data, offsets, runs)
    text = data.tobytes()
    for last, doc, t, e in zip(runs.last.tolist(), runs.doc.tolist(), to.tolist(), at_end.tolist(), strict=True):
        end = int(offsets[doc + 1]) - 1
        rises = lambda i: next((text[k + 1] > text[k] for k in range(i, len(text) - 1) if text[k + 1] != text[k]), False)
        want = next((i for i in range(last, end) if rises(i)), end)
        assert (t, e) == (want, want == end)


def test_reach_takes_few_arrays():
    """A chunk of text is held beside a few arrays over its bytes, most of them of single bytes."""
    n = 1 << 20
    data = np.random.default_rng(6).integers(97, 123, n).astype(np.uint8)
    offsets = np.arange(0, n + 1, 1 << 12)
    runs = suffixes.Runs(data, offsets, 50, suffixes.ANCHOR)
    assert peak_bytes(suffixes.reach, data, offsets, runs)[1] < 14 * n


def test_encoder_keeps_a_bounded_table():
    """However many different words a worker meets, what it keeps of them stays small."""
    from ledgerloom.llm import bpe

    enc = bpe.Encoder(bpe.vocabulary_path())
    tracemalloc.start()
    try:
        for lo in range(0, 390_000, 1_000):
            enc.encode(" ".join("".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(lo, lo + 1_000)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 << 20


def test_long_words_have_the_ids_of_short_merges():
    from ledgerloom.llm import bpe

    enc = bpe.Encoder(bpe.vocabulary_path())
    for word in ("ab" * 90, "the" * 60, "é" * 80, "internationalization" * 9):
        assert enc.merge_long(word.encode()) == enc.merge(word.encode())
