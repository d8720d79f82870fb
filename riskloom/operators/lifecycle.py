"""States of jobs, chunks, workers and schedules as folds over their events, and what is counted over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import materialise
from .ordering import numbered

# --- fixed values: what an event does to a state; an event a state doesn't know leaves it --------------------------
JOB = {
    "start": {"pending": "running"},
    "complete": {"running": "completed"},
    "fail": {"running": "failed"},
    "cancel": {"pending": "cancelled", "running": "cancelled"},
}
CHUNK = {
    "assign": {"pending": "assigned"},
    "complete": {"assigned": "completed"},
    "fail": {"assigned": "failed"},
    "retry": {"failed": "pending"},
    "lost": {"assigned": "pending"},
}
SCHEDULE = {
    "disable": {"idle": "disabled", "running": "disabled"},
    "enable": {"disabled": "idle"},
    "trigger": {"idle": "running"},  # a running schedule skips the trigger
    "finish": {"running": "idle"},
}
WORKER = {
    "heartbeat": {"offline": "idle"},
    "load": {"idle": "busy"},
    "free": {"busy": "idle"},
    "timeout": {"idle": "offline", "busy": "offline"},
}
TERMINAL = ("completed", "failed", "cancelled")


def states_of(table: Mapping[str, Mapping[str, str]], start: str) -> list[str]:
    return list(dict.fromkeys([start, *[s for moves in table.values() for pair in moves.items() for s in pair]]))


def _ordered_parts(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``key, __part, *columns`` in ranges of (key, order): a key's events lie in consecutive parts, each of bounded size."""
    parts = events.where(F.col(key).isNotNull()).select(key, *order, *columns).repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id())
    return materialise(parts, "ordered-events")  # the part of a row must not change between two readings


def fold_states(events: DataFrame, key: str, order: Sequence[str], event: Column, table: Mapping[str, Mapping[str, str]], start: str) -> DataFrame:
    """``key, state, events``: the state of each key after all its events in order, from ``start``.

    An event is a function from state to state, and functions can be put together before the state is known. So the
    events are cut into ranges of bounded size, each range of a key becomes one function (an array with the end state
    for every start state), and a key puts its few functions together in order: a key with a third of all events is
    spread over as many tasks as its events fill. ``order`` must be unique within a key to be repeatable; a null event
    or one the table doesn't know changes nothing. Null keys are left out. No events, no rows.
    """
    names = states_of(table, start)
    at = {s: i for i, s in enumerate(names)}
    moves = {e: [at[m.get(s, s)] for s in names] for e, m in table.items()}
    same = F.array(*[F.lit(i) for i in range(len(names))])
    vector = same
    for e, to in moves.items():
        vector = F.when(F.col("__e") == e, F.array(*[F.lit(i) for i in to])).otherwise(vector)
    rows = _ordered_parts(events.withColumn("__e", event), key, order, ["__e"]).select(key, "__part", *order, vector.alias("f"))
    then = lambda a, f: F.transform(a, lambda s: F.element_at(f, s + 1))  # noqa: E731 - first a, then f
    parts = rows.groupBy(key, "__part").agg(F.array_sort(F.collect_list(F.struct(*order, "f"))).alias("fs"), F.count(F.lit(1)).alias("n"))
    parts = parts.select(key, "__part", "n", F.aggregate("fs", same, lambda a, x: then(a, x["f"])).alias("f"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__part", "f"))).alias("fs"), F.sum("n").alias("events"))
    end = F.element_at(F.aggregate("fs", same, lambda a, x: then(a, x["f"])), 1)
    return whole.select(key, F.element_at(F.array(*[F.lit(s) for s in names]), end + 1).alias("state"), "events")


def floored_sum(events: DataFrame, key: str, order: Sequence[str], delta: str) -> DataFrame:
    """``key, total``: the running sum of ``delta`` in order, which never falls below 0 (a worker's load).

    The end value is the sum less the lowest point the plain sum ever reaches (if below 0); both are put together
    from ranges of bounded size as in ``fold_states``. A null delta counts as 0.
    """
    rows = _ordered_parts(events, key, order, [delta])
    step = F.coalesce(F.col(delta).cast("bigint"), F.lit(0).cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("low"))
    join = lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), F.least(a["low"], a["s"] + x["low"]).alias("low"))
    one = F.struct(*order, step.alias("s"), F.least(step, F.lit(0).cast("bigint")).alias("low"))
    parts = rows.groupBy(key, "__part").agg(F.array_sort(F.collect_list(one)).alias("xs")).select(key, "__part", F.aggregate("xs", zero, join).alias("x"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__part", F.col("x.s").alias("s"), F.col("x.low").alias("low")))).alias("xs"))
    end = F.aggregate("xs", zero, join)
    return whole.select(key, (end["s"] - end["low"]).alias("total"))


def worker_status(load: Column, capacity: Column, seen: Column, as_of: Column, timeout_s: int = 30) -> Column:
    """'offline' without a sign for ``timeout_s`` seconds, 'busy' from full capacity on, else 'idle'."""
    return F.when(F.unix_seconds(as_of) - F.unix_seconds(seen) > timeout_s, "offline").when(load >= capacity, "busy").otherwise("idle")


def rebalance(chunks: DataFrame, workers: DataFrame, as_of: Column, timeout_s: int = 30) -> DataFrame:
    """``chunk, worker, status``: assigned chunks of stale or unknown workers go back to pending, without a worker."""
    live = workers.select(F.col("worker").alias("__w"), (F.unix_seconds(as_of) - F.unix_seconds("seen") <= timeout_s).alias("__ok"))
    rows = chunks.join(live, F.col("worker") == F.col("__w"), "left")
    lost = (F.col("status") == "assigned") & ~F.coalesce("__ok", F.lit(False))
    return rows.select("chunk", F.when(~lost, F.col("worker")).alias("worker"), F.when(lost, "pending").otherwise(F.col("status")).alias("status"))


def jobs_complete(chunks: DataFrame) -> DataFrame:
    """``job, chunks, done, complete``: a job is complete when all its chunks are."""
    done = F.count_if(F.col("status") == "completed")
    return chunks.groupBy("job").agg(F.count(F.lit(1)).alias("chunks"), done.alias("done"), (done == F.count(F.lit(1))).alias("complete"))


def progress(results: Column, targets: Column) -> Column:
    """Share of targets with a result in percent, within 0..100; 0 without targets."""
    return F.coalesce(F.least(F.greatest(F.try_divide(results * 100.0, targets), F.lit(0.0)), F.lit(100.0)), F.lit(0.0))


def update_targets(targets: DataFrame, results: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every target with ``columns`` of its latest result (null without one); mergeable, combined before the shuffle."""
    best = results.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("__b"))
    return targets.join(best, F.col(key) == F.col("__k"), "left").select(*targets.columns, *[F.col("__b")[c].alias(c) for c in columns])


def with_unreachable(targets: DataFrame, alive: DataFrame, key: str) -> DataFrame:
    """``key, success, error``: reachable targets as successes, the others appended as failures."""
    ok = targets.join(alive.select(key).distinct(), key, "left_semi").select(key, F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    bad = targets.join(alive.select(key).distinct(), key, "left_anti").select(key, F.lit(False).alias("success"), F.lit("unreachable").alias("error"))
    return ok.unionByName(bad)


def queue_statistics(jobs: DataFrame) -> DataFrame:
    """``priority, queued, finished, avg_wait_ms, per_hour``: the queue by priority; wait is started less created,
    throughput is what finished over the hours from the first start to the last end."""
    wait = (F.unix_micros("started_at") - F.unix_micros("created_at")) / 1000
    done = F.count_if(F.col("status").isin(*TERMINAL))
    hours = (F.unix_micros(F.max("ended_at")) - F.unix_micros(F.min("started_at"))) / 3_600_000_000
    return jobs.groupBy("priority").agg(
        F.count_if(F.col("status") == "pending").alias("queued"), done.alias("finished"), F.round(F.avg(wait), 4).alias("avg_wait_ms"), F.round(F.try_divide(done, hours), 6).alias("per_hour")
    )


def dequeue_order(jobs: DataFrame) -> DataFrame:
    """``id, place``: the order in which pending jobs leave the queue: priority, then age, then id."""
    rank = fixed.switch(F.col("priority"), {"critical": 0, "high": 1, "medium": 2, "low": 3}, 4)
    rows = jobs.where("status = 'pending'").select("id", rank.alias("rank"), "created_at")
    return numbered(rows, ["rank", F.asc_nulls_last("created_at"), "id"], "place").select("id", "place")


def evictions(cache: DataFrame, keep: int) -> DataFrame:
    """``key, place``: the entries to drop so that ``keep`` stay: the least used first, then the oldest, then by key."""
    over = max(0, cache.count() - keep)
    return numbered(cache.select("key", "hits", "at"), ["hits", "at", "key"], "place").where(F.col("place") <= over).select("key", "place")


def next_run(kind: Column, cron_next: Column, interval_s: Column, last: Column, start: Column, end: Column, as_of: Column) -> Column:
    """When a schedule runs next: by cron, every ``interval_s`` seconds after the last run, or once at its start; never
    before ``start`` or the reference time, null once ``end`` is passed or a one-time run is done."""
    s = lambda c: F.unix_seconds(c)
    first = F.greatest(s(start), s(as_of))
    base = F.coalesce(s(last), s(start))
    missed = F.greatest(F.ceil((s(as_of) - base) / interval_s), F.lit(1).cast("bigint"))
    again = F.when(last.isNull() & (s(start) >= s(as_of)), s(start)).otherwise(base + missed * interval_s)
    at = F.when(kind == "cron", s(cron_next)).when(kind == "interval", again).when((kind == "once") & last.isNull(), first)
    return F.when(end.isNull() | (at <= s(end)), F.timestamp_seconds(at))


def retry_plan(failed: DataFrame, key: str, delay_s: float, attempts: int) -> DataFrame:
    """``key, attempt, delay_s``: linear back-off, ``delay_s`` times the number of the attempt."""
    tries = F.sequence(F.lit(1), F.lit(attempts))
    return failed.select(key, F.explode(tries).alias("attempt")).withColumn("delay_s", F.col("attempt") * F.lit(float(delay_s)))


def select_targets(inv: DataFrame, kind: str, values: Sequence[str] = (), exclude: Sequence[str] = (), query: str | None = None, tags: str = "services") -> DataFrame:
    """The targets of a schedule: 'all', 'zones', 'tags', 'list' (ids) or 'query' (a predicate), without ``exclude``."""
    test = {
        "all": lambda: F.lit(True), "zones": lambda: F.col("zone").isin(*values), "list": lambda: F.col("id").isin(*values),
        "tags": lambda: F.arrays_overlap(F.col(tags), F.array(*[F.lit(v) for v in values])), "query": lambda: F.expr(query or "true"),
    }[kind]()
    return inv.where(F.coalesce(test, F.lit(False)) & ~F.col("id").isin(*exclude) if exclude else F.coalesce(test, F.lit(False)))


def config_findings(hosts: DataFrame, key: str, sshd: str, firewall: str) -> DataFrame:
    """``key, misconfig_id, severity``: two simple detections over texts: root login allowed, firewall inactive."""
    rules = [(F.col(sshd).rlike(r"(?m)^\s*PermitRootLogin\s+yes"), "M001", "high"), (F.lower(F.col(firewall)).rlike(r"\binactive\b"), "M019", "medium")]
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(m).alias("misconfig_id"), F.lit(s).alias("severity"))) for t, m, s in rules]))
    return hosts.select(key, F.explode(hits).alias("h")).select(key, "h.*")


def platform(port: Column) -> Column:
    """Which collector fits: remote management ports mean Windows, all else Linux."""
    return F.when(port.isin(5985, 5986), "windows").otherwise("linux")


def coarse_reach(source: Column, target: Column) -> Column:
    """Whether a zone kind reaches another by the short list; unknown kinds reach nothing."""
    out = F.lit(False)
    for zone, reached in fixed.groups(fixed.ZONE_REACH_COARSE):
        out = F.when(source == zone, target.isin(*reached)).otherwise(out)
    return F.coalesce(out, F.lit(False))

