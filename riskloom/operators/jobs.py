"""Scan jobs: lists, statistics, priorities, chunks, assignment, schedules, caches, rates."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from .ordering import numbered

# --- fixed values: parts of the priority -----------------------------------------------------------------------
BASE = {"critical": 1000, "high": 750, "medium": 500, "low": 250}
ZONE = {"dmz": 100, "restricted": 75, "cloud": 60, "internal": 50}
DATA = {"public": 0, "internal": 10, "confidential": 30, "restricted": 50}


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def priority(base: Column, zone: Column, criticality: Column, exposed: Column, revenue: Column, data: Column, compliance: Column, age_s: Column, weights: dict | None = None) -> Column:
    """The score of a task; missing parts add nothing, every weight can be overridden (0 is a value)."""
    w = {"criticality": 20, "exposed": 40, "revenue": 0.00001, "compliance": 15, "age": 0.1} | (weights or {})
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = fixed.switch(base, BASE, 0) + fixed.switch(zone, ZONE, 0) + zero(criticality) * w["criticality"] + F.when(exposed, w["exposed"]).otherwise(0)
    score = score + F.when(revenue > 0, F.log10(revenue) * w["revenue"]).otherwise(0.0) + fixed.switch(data, DATA, 0) + zero(compliance) * w["compliance"] + zero(age_s) * w["age"]
    return half_up(score)


def page(jobs: DataFrame, where: Column, offset: int, limit: int) -> DataFrame:
    """One page of a job list, newest first, ties by id."""
    return jobs.where(where).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def fill_first(chunks: DataFrame, workers: DataFrame, per_capacity: int = 2) -> DataFrame:
    """``chunk, worker``: pending chunks to workers, the least loaded (share of capacity) filled first.

    A worker takes ``capacity x per_capacity - load`` chunks. Chunks and workers are numbered in their orders; a
    worker owns the numbers up to its running room, one row each (rooms are small), so the assignment is an equi-join
    on the number. Chunks beyond all rooms come out without a worker.
    """
    room = F.greatest(F.col("capacity") * per_capacity - F.col("load"), F.lit(0))
    order = Window.orderBy(F.col("load") / F.col("capacity"), "worker")  # the workers: a cluster's node list
    w = workers.where("status NOT IN ('offline', 'error') AND load < capacity").withColumn("room", room)
    w = w.withColumn("upto", F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = numbered(chunks, ["chunk"], "n")
    slots = w.where("room > 0").select("worker", F.explode(F.sequence(F.col("upto") - F.col("room") + 1, F.col("upto"))).alias("n"))
    return n.join(slots, "n", "left").select("chunk", "worker")


def cron_field(text: str, low: int, high: int) -> set[int]:
    """The values of one cron field: '*', '*/n', 'a-b', 'a-b/n', 'a', lists of them."""
    out: set[int] = set()
    for part in text.split(","):
        body, _, step = part.partition("/")
        a, _, b = body.partition("-")
        first, last = (low, high) if body == "*" else (int(a), int(b or (high if step else a)))
        if not low <= first <= last <= high or (step and int(step) < 1):
            raise ValueError(f"{part!r} is no cron value within {low}..{high}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def next_cron(expression: str, after: Column, days: int = 366) -> Column:
    """The first minute after ``after`` that fits a five-field cron text (all fields must fit), null within ``days``.

    Days are tried before minutes: first the earliest fitting day, then the earliest fitting minute of it.
    """
    minute, hour, dom, month, dow = expression.split()
    minutes = sorted(h * 60 + m for h in cron_field(hour, 0, 23) for m in cron_field(minute, 0, 59))
    doms, months, dows = cron_field(dom, 1, 31), cron_field(month, 1, 12), {d % 7 for d in cron_field(dow, 0, 7)}
    start = F.date_trunc("minute", after) + F.expr("INTERVAL 1 MINUTE")
    day0 = F.to_date(start)

    def fits(d: Column) -> Column:
        return F.dayofmonth(d).isin(*doms) & F.month(d).isin(*months) & (F.dayofweek(d) - 1).isin(*dows)

    at = F.hour(start) * 60 + F.minute(start)
    today = F.array_min(F.filter(F.array(*[F.lit(m) for m in minutes]), lambda m: m >= at))
    later = F.array_min(F.filter(F.sequence(F.date_add(day0, 1), F.date_add(day0, days)), fits))
    stamp = lambda d, m: F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + m * 60)
    return F.when(fits(day0) & today.isNotNull(), stamp(day0, today)).otherwise(stamp(later, F.lit(minutes[0])))


def cache_state(cached: DataFrame, current: DataFrame, key: str, as_of: Column, ttl_s: int) -> DataFrame:
    """``key, state``: hit (same hash, fresh), stale (too old), changed (other hash) or miss."""
    c = cached.select(F.col(key).alias("__k"), F.col("hash").alias("__h"), F.col("cached_at").alias("__at"))
    age = F.unix_seconds(as_of) - F.unix_seconds("__at")
    state = F.when(F.col("__k").isNull(), "miss").when(F.col("hash") != F.col("__h"), "changed").when(age > ttl_s, "stale").otherwise("hit")
    return current.join(c, F.col(key) == F.col("__k"), "left").select(key, state.alias("state"))


def aimd(df: DataFrame, key: str, order: Sequence[str], windows: Sequence[str] = ("n", "errors", "timeouts"), start: int = 20, low: int = 1, high: int = 100) -> DataFrame:
    """``key, rate, cuts, raises``: the adaptive rate after all windows of a key, folded in order.

    A window of ten or more events halves the rate if over 10 % are errors or over 5 % timeouts, else adds 2 once
    five seconds passed since the last error and the last change. ``order`` is the window's second. The windows
    of one key are one array (a count per second, not the events), folded by ``aggregate`` inside the JVM.
    """
    n, errors, timeouts = windows
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order[0]).alias("t"), F.col(n).alias("n"), F.col(errors).alias("e"), F.col(timeouts).alias("o")))).alias("w"))
    zero = F.struct(F.lit(start).alias("rate"), F.lit(-(10**9)).cast("bigint").alias("err"), F.lit(-(10**9)).cast("bigint").alias("adj"), F.lit(0).alias("cuts"), F.lit(0).alias("raises"))

    def step(a: Column, w: Column) -> Column:
        enough = w["n"] >= 10
        err = F.when(w["e"] > 0, w["t"]).otherwise(a["err"])
        cut = enough & ((w["e"] / w["n"] > 0.1) | (w["o"] / w["n"] > 0.05))
        up = enough & ~cut & (w["t"] - err > 5) & (w["t"] - a["adj"] > 5)
        rate = F.when(cut, F.greatest(F.lit(low), F.floor(a["rate"] * 0.5).cast("int"))).when(up, F.least(F.lit(high), a["rate"] + 2)).otherwise(a["rate"])
        return F.struct(rate.alias("rate"), err.alias("err"), F.when(cut | up, w["t"]).otherwise(a["adj"]).alias("adj"), (a["cuts"] + F.when(cut, 1).otherwise(0)).alias("cuts"), (a["raises"] + F.when(up, 1).otherwise(0)).alias("raises"))

    return rows.select(key, F.aggregate("w", zero, step).alias("s")).select(key, "s.rate", "s.cuts", "s.raises")


def controlled_rates(windows: DataFrame, controls: DataFrame, key: str, t: str, start: int = 20, low: int = 1, high: int = 100, keep: int = 100) -> DataFrame:
    """``key, rate, paused, history``: adaptive rates with control events, and the last ``keep`` changes of each key.

    ``windows``: key, t, n, e, o, one row per key and bucket; ``controls``: key, t, control ('pause', 'resume', 'set',
    'reset'), value. In one bucket controls come before the counts, in the order named. While a key is paused its
    windows change nothing. ``set`` takes ``value`` within ``low..high``, ``reset`` goes back to ``start`` and forgets
    the last error and change. ``history`` holds (t, rate, why), the latest last. What one key folds is a row per bucket.
    """
    turn = {"pause": 0, "resume": 1, "set": 2, "reset": 3}
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    row = lambda *cs: F.struct(*[c.alias(n) for c, n in zip(cs, ("t", "turn", "what", "value", "n", "e", "o"))])
    a = windows.select(key, row(F.col(t), F.lit(9), none, zero, F.col("n").cast("bigint"), F.col("e").cast("bigint"), F.col("o").cast("bigint")).alias("x"))
    b = controls.select(key, row(F.col(t), fixed.switch(F.col("control"), turn, 8), F.col("control"), F.col("value").cast("bigint"), zero, zero, zero).alias("x"))
    rows = a.unionByName(b).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    past = F.lit(-(10**9)).cast("bigint")
    first = F.struct(F.lit(start).cast("bigint").alias("rate"), past.alias("err"), past.alias("adj"), F.lit(False).alias("paused"), F.array().cast("array<struct<t:bigint,rate:bigint,why:string>>").alias("history"))

    def step(s: Column, x: Column) -> Column:
        act = x["what"].isNull() & ~s["paused"]
        enough = act & (x["n"] >= 10)
        err = F.when(x["what"] == "reset", past).when(act & (x["e"] > 0), x["t"]).otherwise(s["err"])
        cut = enough & ((x["e"] / x["n"] > 0.1) | (x["o"] / x["n"] > 0.05))
        up = enough & ~cut & (x["t"] - err > 5) & (x["t"] - s["adj"] > 5)
        bounded = F.least(F.lit(high).cast("bigint"), F.greatest(F.lit(low).cast("bigint"), x["value"]))
        rate = (
            F.when(x["what"] == "set", bounded).when(x["what"] == "reset", F.lit(start).cast("bigint"))
            .when(cut, F.greatest(F.lit(low).cast("bigint"), F.floor(s["rate"] * 0.5))).when(up, F.least(F.lit(high).cast("bigint"), s["rate"] + 2)).otherwise(s["rate"])
        )
        paused = F.when(x["what"] == "pause", True).when(x["what"] == "resume", False).otherwise(s["paused"])
        why = F.when(x["what"].isNotNull(), x["what"]).when(cut, "cut").when(up, "raise")
        more = F.concat(s["history"], F.array(F.struct(x["t"].cast("bigint").alias("t"), rate.alias("rate"), why.alias("why"))))
        history = F.when(why.isNull(), s["history"]).otherwise(F.slice(more, F.greatest(F.size(more) - (keep - 1), F.lit(1)), F.lit(keep)))
        adj = F.when(x["what"] == "reset", past).when(cut | up | (x["what"] == "set"), x["t"]).otherwise(s["adj"])
        return F.struct(rate.alias("rate"), err.alias("err"), adj.alias("adj"), paused.alias("paused"), history.alias("history"))

    return rows.select(key, F.aggregate("xs", first, step).alias("s")).select(key, "s.rate", "s.paused", "s.history")


def token_bucket(df: DataFrame, key: str, seconds: str, rate: float, burst: float) -> DataFrame:
    """``key, granted, refused``: arrivals (their times in seconds) against a token bucket, in order.

    Arrivals of one instant are counted before the shuffle. Each key's instants then pass through its task in order
    with three numbers of state, so a key of any length needs no list. Null keys and times are left out.
    """
    counted = df.where(F.col(key).isNotNull() & F.col(seconds).isNotNull()).groupBy(F.col(key), F.col(seconds).cast("double").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.repartition(key).sortWithinPartitions(key, "t")
    kind = df.schema[key].dataType.simpleString()

    def fold(batches):
        who, left, at, ok, no = None, 0.0, 0.0, 0, 0
        for batch in batches:
            done: list[list] = [[], [], []]
            for k, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k != who:
                    if who is not None:
                        for c, x in zip(done, (who, ok, no)):
                            c.append(x)
                    who, left, at, ok, no = k, float(burst), t, 0, 0
                left, at = min(float(burst), left + (t - at) * rate), t
                take = min(n, int(left))
                left, ok, no = left - take, ok + take, no + n - take
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field(0).type), pa.array(done[1], pa.int64()), pa.array(done[2], pa.int64())], names=[key, "granted", "refused"])
            own = batch.schema.field(0).type
        if who is not None:
            yield pa.RecordBatch.from_arrays([pa.array([who], own), pa.array([ok], pa.int64()), pa.array([no], pa.int64())], names=[key, "granted", "refused"])

    return rows.mapInArrow(fold, f"`{key}` {kind}, granted bigint, refused bigint")


def latest_state(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The latest event of each key; mergeable, so combined before the shuffle."""
    best = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("b")
    return events.groupBy(key).agg(best).select(key, *[F.col("b")[c].alias(c) for c in columns])
