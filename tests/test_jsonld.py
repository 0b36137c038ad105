"""Structured data at any depth, against a plain walk."""

from __future__ import annotations

import json
import random

import pytest

from nearby.sources import jsonld


def walk(node):
    """Every object and list, with its depth."""
    out, todo = [], [(0, node)]
    while todo:
        depth, x = todo.pop()
        if isinstance(x, dict | list):
            out.append(depth)
            todo += [(depth + 1, y) for y in (x.values() if isinstance(x, dict) else x)]
    return sorted(out)


def nested(depth, rng):
    event = {"@type": "Event", "name": f"At {depth}", "startDate": "2026-10-01T10:00"}
    for _ in range(depth):
        event = rng.choice([lambda e: [e], lambda e: [1, "x", e, None], lambda e: {"a": e}, lambda e: {"@graph": [], "item": e}])(event)
    return event


def page(*blocks):
    return "<html>" + "".join(f"<script type='application/ld+json'> {b if isinstance(b, str) else json.dumps(b)} </script>" for b in blocks)


def test_events_at_depths_1_to_40(spark):
    rng = random.Random(1)
    rows = [(d, "https://a.example/", page(nested(d, rng))) for d in range(1, 41)]
    rows += [(100, "https://a.example/", page(nested(9, rng), "{broken", nested(30, rng), {"@type": "Place"})), (101, "https://a.example/", None), (102, "https://a.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["name"]) for r in jsonld.jsonld_events(df).collect())
    assert got == sorted([(d, f"At {d}") for d in range(1, 41)] + [(100, "At 9"), (100, "At 30")])


@pytest.mark.parametrize("seed", [1, 2])
def test_all_nodes_are_walked(spark, seed):
    rng = random.Random(seed)

    def make(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([1, "text", None, True, [], {}])
        return [make(depth - 1) for _ in range(rng.randint(0, 3))] if rng.random() < 0.5 else {f"k{i}": make(depth - 1) for i in range(rng.randint(0, 3))}

    trees = {i: make(rng.randint(1, 16)) for i in range(30)}
    df = spark.createDataFrame([(i, "u", page(t)) for i, t in trees.items()], "page_id long, url string, html string")
    got = {}
    for r in jsonld.nodes(df, "page_id").select("page_id", "level").collect():
        got.setdefault(r["page_id"], []).append(r["level"])
    want = {i: walk(t) for i, t in trees.items()}
    # a block that is no object or list has one node all the same
    assert {i: sorted(x) for i, x in got.items() if want[i]} == {i: w for i, w in want.items() if w}
