"""Components against union-find."""

import random

import pytest

from pairforge.llm import components as module
from pairforge.llm.components import components

SCHEMA = "a bigint, b bigint, label string, node string"


def expected(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def shapes():
    draw = random.Random(21)
    chain = list(range(10_000))
    draw.shuffle(chain)
    star = [(7, 10_000 + k) for k in range(3000)] + [(20_000, 10_000)]
    tree = [(30_000 + k, 30_000 + (k - 1) // 2) for k in range(1, 1500)]
    loose = [(draw.randrange(40_000, 41_000), draw.randrange(40_000, 41_000)) for _ in range(700)]
    ring = [(50_000 + k, 50_000 + (k + 1) % 300) for k in range(300)]
    odd = [(60_000, 60_000), (None, 60_001), (60_002, None), (-5, 60_003), (60_003, -5), (60_003, -5), (None, None)]
    return list(zip(chain, chain[1:])), star + tree + loose + ring + odd


@pytest.mark.parametrize("which", [0, 1])
def test_components(spark, which, monkeypatch):
    links = shapes()[which]
    steps = []
    real = module._step
    monkeypatch.setattr(module, "_step", lambda edges, turn: steps.append(turn) or real(edges, turn))
    rows = spark.createDataFrame([(a, b, "x", "y") for a, b in links], SCHEMA)
    assert {r.node: r.label for r in components(rows).collect()} == expected(links)
    assert len(steps) < 20


def test_components_of_nothing(spark):
    none = spark.createDataFrame([(1, 1, "x", "y")], SCHEMA)
    assert components(none).collect() == [] and components(none.limit(0)).collect() == []
    assert components(none).columns == ["node", "label"]


def test_crowded_lists_of_near_copies(spark, monkeypatch):
    """Long lists whose members are linked through others, with the forest pass and after it."""
    from pairforge.llm import minhash_dedup

    draw, texts = random.Random(31), {}
    words = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    for i in range(130):
        own = list(words)
        for _ in range(draw.choice([0, 2, 4, 6, 9])):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        texts[i] = " ".join(own)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(396)} for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = {i: i for i in texts} | expected(links)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == label


def test_spanning_keeps_what_connects():
    import numpy as np

    from pairforge.llm.minhash_dedup import _spanning

    first, second = np.array([1, 1, 2, 4, 5]), np.array([2, 3, 3, 5, 4])
    kept = _spanning(first, second, np.array([30, 40, 41, 28, 29], np.uint8))
    assert sorted(kept.tolist()) == [1, 2, 4]
    assert len(_spanning(first[:0], second[:0], np.zeros(0, np.uint8))) == 0


def test_crowd_of_texts_that_nearly_link_makes_few_pairs(spark, monkeypatch):
    """Signatures of one origin's copies agree, few of their sets do: the pairs stay in the blocks."""
    from pairforge.llm import minhash_dedup

    met, real = [], minhash_dedup._confirmed

    def counted(docs, id_column, text_column, classes, pairs, likeness):
        met.append(pairs.count())
        return real(docs, id_column, text_column, classes, pairs, likeness)

    monkeypatch.setattr(minhash_dedup, "_confirmed", counted)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 64)
    monkeypatch.setattr(minhash_dedup, "COLUMNS", 100, raising=False)
    monkeypatch.setattr(minhash_dedup, "SMALL", 4)
    draw, texts = random.Random(41), {}
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    for i in range(120):
        own = list(words)
        for at in draw.sample(range(300), draw.choice([2, 6, 7, 8])):
            own[at] = f"x{draw.randrange(10**6)}"
        texts[i] = " ".join(own)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = {i: i for i in texts} | expected(links)
    assert len(set(label.values())) > 30
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == label
    assert max(met) < 20 * len(texts), met


def test_overlaps_equal_brute_force():
    import numpy as np
    import pandas as pd

    from pairforge.llm import minhash_dedup

    draw = random.Random(43)
    left, right = ([sorted(draw.sample(range(-9000, 9000), draw.randrange(4000))) for _ in range(n)] for n in (7, 5))
    got = minhash_dedup._overlaps(*(pd.Series([np.array(x, dtype=np.int64) for x in side]) for side in (left, right)))
    assert got.tolist() == [[len(set(a) & set(b)) for b in right] for a in left]
    none = pd.Series([], dtype=object)
    assert minhash_dedup._overlaps(none, none).shape == (0, 0)
