"""Large groups of the near-duplicate join, held against each other in blocks."""

import itertools

import numpy as np
import pytest

from ledgerloom.llm import jaccard
from ledgerloom.llm.jaccard import DELETED, INDEX, PROBE

BOTH = INDEX | PROBE
#: Roles of a group's members: those who ask, and all others.
GROUPS = {"few probe": (BOTH, INDEX), "few are whole": (BOTH, BOTH | DELETED), "few probe only": (PROBE, INDEX), "all do": (BOTH, BOTH)}


def group(spark, roles, size=160, few=8):
    """Members of one group with their nodes; all are alike, and every fourth lies in the main component."""
    rng = np.random.default_rng(7)
    root = rng.integers(1, 40, size) * (rng.random(size) > 0.25)
    rows = [(1, k, roles[k >= few], int(r), 0) for k, r in enumerate(root)]
    member = spark.createDataFrame(rows, "value long, node long, role int, root long, main long")
    nodes = spark.createDataFrame([(k, 50, [5, 6]) for k in range(size)], "node long, n long, sketch array<long>")
    return rows, member, nodes


@pytest.mark.parametrize("name", GROUPS)
def test_blocks_find_every_open_pair(spark, monkeypatch, name):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows, member, nodes = group(spark, GROUPS[name])
    may = lambda x, y: bool(jaccard.may_match(np.array([x]), np.array([y]))[0])
    want = {(x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[3] != y[3] and may(x[2], y[2])}
    got = jaccard.open_pairs(member, nodes, 80).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 0


@pytest.mark.parametrize("name", [n for n in GROUPS if n != "all do"])
def test_blocks_grow_with_their_group(spark, monkeypatch, name):
    """Where few members ask, the rows sent follow the members, and not the square of their number."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    sent = {size: jaccard.blocks(group(spark, GROUPS[name], size)[1]).count() for size in (160, 1600)}
    assert sent[160] < 2 * 160 and sent[1600] < 2 * 1600


def test_group_that_nobody_asks_sends_nothing(spark):
    _, member, nodes = group(spark, (INDEX, INDEX))
    assert jaccard.open_pairs(member, nodes, 80).isEmpty()


def test_only_groups_that_had_more_are_open(spark, monkeypatch):
    """Of two groups, one has more pairs than are sent at once; the other has been looked at whole, and is done."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    _, many, nodes = group(spark, (BOTH, BOTH))
    two = spark.createDataFrame([(2, 0, BOTH, 0, 0), (2, 1, BOTH, 77, 0)], many.schema)
    got = jaccard.open_pairs(many.unionAll(two), nodes, 80, 0).collect()
    assert {v for r in got for v in r["cut"]} == {1}
    got = jaccard.open_pairs(two, nodes, 80, 0).collect()
    assert [(r["a"], r["b"], r["cut"]) for r in got] == [(0, 1, [])]


def test_last_round_leaves_finished_groups(spark, monkeypatch):
    """A round after the first takes only the groups that had more pairs, and finds the same components."""
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "FEW", 1)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    words = [f"w{k}" for k in range(400)]
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):  # twelve originals, each with copies that lack a word
        own = words[30 * (k % 12) : 30 * (k % 12) + 40]
        texts.append((k, " ".join(w for i, w in enumerate(own) if k < 12 or i != rng.integers(0, 40))))
    asked, whole = [], jaccard.blocks
    monkeypatch.setattr(jaccard, "blocks", lambda member: asked.append({r["value"] for r in member.select("value").distinct().collect()}) or whole(member))
    got = jaccard.near_components(spark.createDataFrame(texts, "doc_id long, text string"), 1, 80).collect()
    sets = {k: set(t.split()) for k, t in texts}
    component = {k: k for k in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                component[a] = component[b] = min(component[a], component[b])
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert all(later <= first for first, later in itertools.pairwise(asked))
