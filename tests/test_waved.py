"""Days waved off are passed over by as many steps as they can take, not by all that may be looked at."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from nearby.operators import recur

NOW = dt.datetime(2024, 5, 15, 12)


def occurrences(start: dt.datetime, cadence: str):
    """All from now on, month by month or step by step. A first day to come stands as it is."""
    for k in range(400):
        if cadence == "monthly":
            y, m = divmod(start.year * 12 + start.month - 1 + k, 12)
            last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
            at = start.replace(year=y, month=m + 1, day=min(start.day, last))
        else:
            at = start + dt.timedelta(days=k * recur.STEP_DAYS[cadence])
        if at >= NOW:
            if cadence == "weekday" and at.weekday() > 4 and (k or start < NOW):
                at += dt.timedelta(days=7 - at.weekday())
            yield at


def test_steps_over_waved_days(spark):
    rng, made, waved, want = random.Random(4), [], [], {}
    for i in range(120):
        cadence = rng.choice([*recur.STEP_DAYS, "monthly"])
        start = NOW + dt.timedelta(days=rng.randrange(-90, 20), hours=rng.randrange(24))
        own = list(dict.fromkeys(x.date() for x in occurrences(start, cadence)))[: rng.randrange(0, 9)]
        own = [x for n, x in enumerate(own) if n != 6] + [dt.date(2020, 1, 1)] * (i % 2)
        made.append((f"s{i}", start, None, True, cadence, None))
        waved += [(f"s{i}", x) for x in own]
        want[f"s{i}"] = next(x for x in occurrences(start, cadence) if x.date() not in own)
    df = spark.createDataFrame(made, "id string, start_at timestamp_ntz, end_at timestamp_ntz, repeats boolean, cadence string, until_at timestamp_ntz")
    out = recur.live_listings(df, F.lit(NOW).cast("timestamp_ntz"), spark.createDataFrame(waved, "id string, day date"))
    plan = out._jdf.queryExecution().optimizedPlan().toString().replace(" ", "")
    assert "transform(sequence(1,least(" in plan and "transform([1,2,3" not in plan  # as many as the days ask for
    assert {r["id"]: r["next_at"] for r in out.collect()} == want
