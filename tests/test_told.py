"""Pairs of cars and places ahead are made last, from arrays of alike cars and of places in one spot."""

from __future__ import annotations

import pytest

from nearby.operators import drive


@pytest.mark.parametrize("chunk", [512, 2])
def test_pairs_are_told_last(spark, monkeypatch, chunk):
    monkeypatch.setattr(drive, "CHUNK", chunk, raising=False)
    cars = [(c, 41.0, -73.0, 0.0, 40.0) for c in (1, 2, 3, 4, 5, None)] + [(9, 41.0, -73.0, 180.0, 40.0), (10, 41.0, -73.0, None, 40.0)]
    places = [(f"p{i}", 41.05, -73.0) for i in range(7)] + [(None, 41.05, -73.0), ("q", 41.06, -73.0), ("r", 40.95, -73.0), ("s", None, None)]
    out = drive.ahead_by_heading(spark.createDataFrame(cars, "car long, lat double, lon double, heading double, speed double"), spark.createDataFrame(places, "id string, lat double, lon double"), digits=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")
    north, south = [p[0] for p in places if p[1] and p[1] > 41], ["r"]
    want = [(c, p) for c in (1, 2, 3, 4, 5, None) for p in north] + [(9, p) for p in south]
    assert sorted(((r["car"], r["id"]) for r in out.collect()), key=str) == sorted(want, key=str) and len(want) == 55
