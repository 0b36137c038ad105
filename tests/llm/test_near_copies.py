"""The pipeline's near-copy stage against brute-force similarity of five-word shingles."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from nearby.llm import near_copies, simhash


def brute_shingles(text):
    words = bytes(text or "", "utf-8").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """Id -> smallest id that links of similarity 0.8 or more lead to."""
    root, sets = {i: i for i, _ in rows}, [(i, brute_shingles(t)) for i, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s or {None}:
            by_shingle[x].add(n)
    for n, (i, s) in enumerate(sets):
        for m in set().union(*(by_shingle[x] for x in s or {None})):
            j, t = sets[m]
            if m < n and (s == t or 9 * len(s & t) >= 4 * (len(s) + len(t))):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def family(seed=5):
    """Texts and copies of them with words changed, so that similarities lie on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 9, 40, 120, 400]))]
        for _ in range(rng.randint(1, 5)):
            rows.append(list(words))
            for _ in range(rng.choice([0, 1, 1, max(1, len(words) // 45), len(words) // 20])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def stage(spark, rows):
    """The pipeline's own stage over rows (doc_id, text)."""
    import corpus_pipeline

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())


def drop(df):
    return simhash.drop_near_duplicates(df, similarity=0.8)


def test_stage_against_brute_force(spark, docs):
    for rows in (family(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]):
        want = sorted(i for i, c in brute_components(rows).items() if i == c)
        assert len(want) < len(rows)
        assert stage(spark, rows) == want


def test_large_groups_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CELL", 4)
    rows = family(6)
    assert stage(spark, rows) == sorted(i for i, c in brute_components(rows).items() if i == c)


def test_vast_groups_are_compared_in_cells(spark, monkeypatch):
    """Texts that drift apart word by word: candidates make one group of them, exact links many."""
    rng, words, rows, taken = random.Random(7), [f"w{i}" for i in range(60)], [], []
    for i in range(200):
        rows.append((i, " ".join(words)))
        for at in rng.sample(range(0, 60, 6), rng.choice([1, 1, 2, 3])):
            words[at + rng.randrange(6)] = f"x{i}-{at}"
    monkeypatch.setattr(near_copies, "CELL", 4)
    monkeypatch.setattr(near_copies, "MANY", 2)
    real = near_copies.compared_in_cells
    monkeypatch.setattr(near_copies, "compared_in_cells", lambda *a: taken.append(1) or real(*a))
    want = sorted(i for i, c in brute_components(rows).items() if i == c)
    assert stage(spark, rows) == want and 20 < len(want) < 180 and taken


def test_edge_rows(spark, edges, none):
    kept = [r["doc_id"] for r in drop(edges).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 4, 5, 7, 8, 9] and kept.count(None) == 2  # two texts without an id, like no other
    assert drop(none).count() == 0
    # A text without an id links the texts on its two sides.
    words = [f"w{i}" for i in range(100)]
    other = [f"x{i}" for i in range(10)]
    chain = [" ".join(w) for w in (other + words[10:], words, words[:90] + other)]
    assert stage(spark, list(enumerate(chain))) == [0]
    assert stage(spark, [(0, chain[0]), (2, chain[2])]) == [0, 2]
    bridged = drop(spark.createDataFrame([(1, chain[0]), (None, chain[1]), (2, chain[2])], "doc_id long, text string"))
    assert sorted((r["doc_id"] for r in bridged.collect()), key=str) == [1]


def test_exact_bound():
    """4 of 5 shingles in common link, one less doesn't."""
    s = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [1, 2, 3, 6], [7])]
    assert near_copies.near_forest(s) == [(0, 1)]
