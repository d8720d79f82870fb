"""The token bucket takes every event of a user."""

import random
from datetime import datetime, timedelta

from riskloom.plans import catalog


def test_all_events_take_tokens(spark, tmp_path):
    rng = random.Random(11)
    start = datetime(2025, 1, 1)
    rows = [(n, start + timedelta(seconds=rng.randrange(0, 2_000_000)), rng.choice(["error", "view", "click"]), rng.randrange(0, 12)) for n in range(300)]
    rows += [(300 + n, start + timedelta(seconds=n), "view", 99) for n in range(4)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, event_type string, user_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for user in {r[3] for r in rows}:
        left, at, granted, refused = 2.0, None, 0, 0
        for t in sorted((r[1] - start).total_seconds() for r in rows if r[3] == user):
            left, at = min(2.0, left + (0 if at is None else (t - at) * 0.00001)), t
            if left >= 1:
                left, granted = left - 1, granted + 1
            else:
                refused += 1
        want[user] = (granted, refused)
    got = {r.user_id: (r.granted, r.refused) for r in catalog.QUERIES["request_buckets"](spark, str(tmp_path)).collect()}
    assert got == want and got[99] == (2, 2)
    assert sum(a + b for a, b in got.values()) == len(rows)
