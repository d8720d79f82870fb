"""Rates with control events, streams in several triggers, notification."""

import random

from pyspark.sql import functions as F

from riskloom.operators import jobs
from riskloom.plans import catalog
from riskloom.session import scratch_path
from riskloom.streaming import scan_events as st


def test_controlled_rates_against_a_loop(spark):
    rng = random.Random(5)
    windows = [(k, t, rng.choice([5, 10, 40]), rng.choice([0, 0, 0, 3, 20]), rng.choice([0, 0, 0, 4])) for k in "ab" for t in range(0, 900, 3)]
    windows = [(k, t, n, min(e, n), min(o, n)) for k, t, n, e, o in windows]
    controls = [(rng.choice("ab"), rng.randrange(0, 900), rng.choice(["pause", "resume", "set", "reset"]), rng.choice([0, 7, 300])) for _ in range(40)]
    controls = list({(k, t, c): (k, t, c, v) for k, t, c, v in controls}.values())
    turn = {"pause": 0, "resume": 1, "set": 2, "reset": 3}
    want = {}
    for key in "ab":
        rows = sorted([(t, 9, None, n, e, o) for k, t, n, e, o in windows if k == key] + [(t, turn[c], c, v, 0, 0) for k, t, c, v in controls if k == key], key=lambda r: r[:2])
        rate, err, adj, paused, history = 20, -(10**9), -(10**9), False, []
        for t, _, what, n, e, o in rows:
            why = what
            if what == "pause" or what == "resume":
                paused = what == "pause"
            elif what == "set":
                rate, adj = min(100, max(1, n)), t
            elif what == "reset":
                rate, err, adj = 20, -(10**9), -(10**9)
            elif not paused:
                err = t if e else err
                if n >= 10 and (e / n > 0.1 or o / n > 0.05):
                    rate, adj, why = max(1, rate // 2), t, "cut"
                elif n >= 10 and t - err > 5 and t - adj > 5:
                    rate, adj, why = min(100, rate + 2), t, "raise"
            if why:
                history = (history + [(t, rate, why)])[-10:]
        want[key] = (rate, paused, history)
    w = spark.createDataFrame(windows, "k string, t bigint, n int, e int, o int")
    c = spark.createDataFrame(controls, "k string, t bigint, control string, value int")
    got = {r.k: (r.rate, r.paused, [tuple(h) for h in r.history]) for r in jobs.controlled_rates(w, c, "k", "t", keep=10).collect()}
    assert got == want and all(len(h) == 10 for _, _, h in want.values())


def test_rates_over_several_triggers(spark, sf):
    """Nothing is lost between triggers: the state and the final rates cover all events of every job."""
    rows = st.run(st.adaptive_rate(st.scan_events(st.deliveries(spark, sf))), "update", "rates", ["job"]).collect()
    assert len(rows) == len({r.job for r in rows}) == 10 and all(1 <= r.rate <= 100 for r in rows)
    part = st.partial_counts(st.scan_events(spark.read.parquet(f"{sf}/events.parquet")).repartition(5))
    whole = st.scan_events(spark.read.parquet(f"{sf}/events.parquet"))
    assert part.agg(F.sum("n"), F.sum("e"), F.sum("o")).first() == whole.agg(F.count(F.lit(1)), F.count_if(F.col("kind") == "target_error"), F.count_if(F.col("kind") == "timeout")).first()


def test_notify(spark, sf):
    seen = []
    q = st.notify(st.job_progress(st.scan_events(st.read(spark, sf))), lambda df, n: seen.append((n, df.count())), scratch_path(spark, "notify"))
    q.processAllAvailable()
    q.stop()
    assert seen and seen[0][1] == 10


def test_late_events_are_fed(spark, sf):
    late = catalog.QUERIES["stream_late_events"](spark, sf).agg(F.sum("n")).first()[0]
    assert 0 < late < spark.read.parquet(f"{sf}/events.parquet").count()
