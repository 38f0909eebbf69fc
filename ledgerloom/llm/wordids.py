"""Token ids of texts under a tokenizer that drops white space: each distinct word is encoded once.

A tokenizer that splits texts at white space and drops it gives a text the ids of its words (runs without white space)
one after another. Texts are cut into words with numpy; a word's ids come from a table of those seen by this task, and
new words go to the ``tokenizers`` library, many in one text, whose tokens tell by their place which word they are of.
"""

from __future__ import annotations

import json

import numpy as np

from .terms import SHORT, SPACES, keys, ragged, runs, spread

_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
# Fixed value: a pattern that cuts words so that letters never share a piece with other signs but an apostrophe.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Short words that a task remembers; beyond that it begins anew.
REMEMBERED = 1_000_000


class WordIds:
    """Ids of words, with a table of the short ones seen so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        added = self.library.get_added_tokens_decoder().values()
        self.marks = [t.content for t in added]
        #: Whether special tokens are found by their exact text alone, whatever stands beside them.
        self.local = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)
        self.kind = self.kinds(json.loads(self.library.to_str())["pre_tokenizer"])
        self.forget()

    def kinds(self, cutter: dict | None) -> np.ndarray | None:
        """Under the known pattern words are cut further, between ASCII letters (1) and plain signs (2), which gives fewer
        distinct ones; signs of special tokens are not cut off."""
        steps = (cutter or {}).get("pretokenizers", [cutter])
        if not any(s and s["type"] == "Split" and s["pattern"].get("Regex") == LETTERS_APART for s in steps):
            return None
        kind = np.zeros(256, np.uint8)
        for c in map(chr, range(0x21, 0x7F)):
            kind[ord(c)] = 1 if c.isalpha() else 2 if not c.isdigit() and c != "'" and not any(c in m for m in self.marks) else 0
        return kind

    def forget(self) -> None:
        none = np.zeros(0, np.uint64)
        self.at, self.low, self.high = none, none, none
        self.start, self.size, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def plainly(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def of_words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (ranges of a buffer) one after another, and their number for each word: one text for all,
        whose tokens say where they stand; words with a special token go alone."""
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = end - begin
        at = np.cumsum(size + 1) - size - 1
        flat = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        flat[ragged(at, size)] = data[ragged(begin, size)]
        text = str(flat, "utf-8")
        if any(m in text for m in self.marks):
            words = text.split(" ")[:-1]
            special = np.array([any(m in w for m in self.marks) for w in words])
            plain = np.flatnonzero(~special)
            ids, number = self.of_words(data, begin[plain], end[plain])
            parts = dict(zip(plain.tolist(), np.split(ids, np.cumsum(number)[:-1]) if len(number) else [], strict=True))
            found = [np.array(self.plainly(w), np.int32) if i not in parts else parts[i] for i, w in enumerate(words)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        got = self.library.encode(text, add_special_tokens=False)
        chars = np.cumsum((flat & 0xC0) != 0x80) - 1
        word = np.searchsorted(chars[at], np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids)), side="right") - 1
        return np.array(got.ids, np.int32), np.bincount(word, minlength=len(size)).astype(np.int64)

    def added(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words lie in the pool now, and their number; they stay there if ``keep``."""
        flat, size = self.of_words(data, begin, end)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(len(self.pool), len(flat)), np.int32))
        self.pool[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat) if keep else 0
        return start, size

    def by_library(self, raw: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.plainly(str(raw[a:b], "utf-8")), np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a buffer one after another, and their number for each text."""
        n, word = len(offsets) - 1, runs(data, offsets, _WORD, self.kind)
        start, size = np.zeros(len(word.start), np.int64), np.zeros(len(word.start), np.int64)
        short = word.end - word.start <= SHORT
        raw = memoryview(np.ascontiguousarray(data))
        if not self.local:
            return self.by_library(raw, offsets)
        if len(self.at) > REMEMBERED:
            self.forget()
        where = np.flatnonzero(short)
        if len(where):
            low, high = keys(data, word.start[where], word.end[where])
            at, one, back = np.unique(spread(low, high), return_index=True, return_inverse=True)
            place = np.searchsorted(self.at, at)
            known = place < len(self.at)
            known[known] = self.at[place[known]] == at[known]
            same = (low[one][back] == low).all() and (high[one][back] == high).all()
            same = same and (self.low[place[known]] == low[one][known]).all() and (self.high[place[known]] == high[one][known]).all()
            if not same:  # two words share a place in the order: this buffer goes without the table
                return self.by_library(raw, offsets)
            new = np.flatnonzero(~known)
            at_new, size_new = self.added(data, word.start[where[one[new]]], word.end[where[one[new]]], True)
            merge = lambda old, fresh: np.insert(old, place[new], fresh)
            self.at, self.low, self.high = merge(self.at, at[new]), merge(self.low, low[one[new]]), merge(self.high, high[one[new]])
            self.start, self.size = merge(self.start, at_new), merge(self.size, size_new)
            place = np.searchsorted(self.at, at)
            start[where], size[where] = self.start[place][back], self.size[place][back]
        where = np.flatnonzero(~short)
        if len(where):
            texts: dict[bytes, int] = {}
            number = np.array([texts.setdefault(bytes(raw[word.start[i] : word.end[i]]), len(texts)) for i in where.tolist()], np.int64)
            one = where[np.unique(number, return_index=True)[1]]
            at_new, size_new = self.added(data, word.start[one], word.end[one], False)
            start[where], size[where] = at_new[number], size_new[number]
        counts = np.bincount(word.doc, size, n).astype(np.int64)
        return self.pool[ragged(start, size)], counts


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
