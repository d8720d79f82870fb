"""Queries over states, queues, caches and schedules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import lifecycle as lc
from ..operators.delivery import latest_delivery
from ..session import table
from . import operations_queries, sql
from .inventory_queries import inv

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2025-12-31 00:00:00"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = oracle
        return f

    return add


W = sql.with_(*sql.BASE)


# --- state machines: the events of a user stand for the events of a job, chunk, schedule or worker -----------------

KINDS = {
    "job": (lc.JOB, "pending", {"view": "start", "purchase": "complete", "error": "fail", "click": "cancel"}),
    "chunk": (lc.CHUNK, "pending", {"view": "assign", "purchase": "complete", "error": "fail", "signup": "retry", "click": "lost"}),
    "schedule": (lc.SCHEDULE, "idle", {"view": "trigger", "purchase": "finish", "error": "disable", "signup": "enable"}),
    "worker": (lc.WORKER, "idle", {"signup": "heartbeat", "view": "load", "purchase": "free", "error": "timeout"}),
}


def _machine(kind: str) -> str:
    moves, start, names = KINDS[kind]
    arms = " ".join(f"WHEN event_type = '{e}' AND r.state = '{a}' THEN '{b}'" for e, n in names.items() for a, b in moves[n].items())
    return f"""WITH RECURSIVE q AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, '{start}' AS state FROM q
  UNION ALL SELECT r.user_id, q.i, CASE {arms} ELSE r.state END FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1)
SELECT user_id AS {kind}, state, i AS events FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""


def _states(kind: str):
    def run(spark, sf_dir):
        moves, start, names = KINDS[kind]
        e = table(spark, sf_dir, "events").select(F.col("user_id").alias(kind), "ts", "event_id", "event_type")
        return lc.fold_states(e, kind, ["ts", "event_id"], fixed.switch(F.col("event_type"), names, None), moves, start)

    run.__doc__ = f"The life cycle of a {kind}, folded over all its events."
    return run


for _kind in KINDS:
    QUERIES[f"{_kind}_states"], ORACLE[f"{_kind}_states"] = _states(_kind), _machine(_kind)


@query("""WITH RECURSIVE q AS (SELECT user_id, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -2 WHEN 'error' THEN -1 ELSE 0 END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS total FROM q UNION ALL SELECT r.user_id, q.i, greatest(0, r.total + q.d) FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1)
SELECT user_id AS worker, total AS load, CASE WHEN total >= 3 THEN 'busy' ELSE 'idle' END AS status FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def worker_loads(spark, sf_dir):
    """The load of each worker, never below 0; busy from a load of 3 on."""
    d = fixed.switch(F.col("event_type"), {"view": 1, "purchase": -2, "error": -1}, 0)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "ts", "event_id", d.alias("d"))
    t = lc.floored_sum(e, "worker", ["ts", "event_id"], "d")
    now = F.lit(AS_OF).cast("timestamp")
    return t.select("worker", F.col("total").alias("load"), lc.worker_status(F.col("total"), F.lit(3), now, now).alias("status"))


# --- chunks and workers: jobs stand for chunks, their creators for workers ------------------------------------------

_CHUNKS = "c AS (SELECT id AS chunk, created_by AS worker, CASE status WHEN 'running' THEN 'assigned' ELSE status END AS status, type AS job FROM scan_jobs), w AS (SELECT created_by AS worker, max(created_at)::TIMESTAMP AS seen FROM scan_jobs WHERE status <> 'running' GROUP BY 1)"


def _chunks(spark, sf_dir):
    j = table(spark, sf_dir, "scan_jobs")
    c = j.select(F.col("id").alias("chunk"), F.col("created_by").alias("worker"), F.when(F.col("status") == "running", "assigned").otherwise(F.col("status")).alias("status"), F.col("type").alias("job"))
    w = j.where("status <> 'running'").groupBy(F.col("created_by").alias("worker")).agg(F.max(F.col("created_at").cast("timestamp")).alias("seen"))
    return c, w


@query(f"WITH {_CHUNKS}, l AS (SELECT worker, seen >= TIMESTAMP '2025-12-31 00:00:00' - INTERVAL 12 HOUR AS ok FROM w) SELECT chunk, CASE WHEN status = 'assigned' AND NOT coalesce(ok, false) THEN NULL ELSE c.worker END AS worker, CASE WHEN status = 'assigned' AND NOT coalesce(ok, false) THEN 'pending' ELSE status END AS status FROM c LEFT JOIN l ON l.worker = c.worker")
def rebalanced_chunks(spark, sf_dir):
    c, w = _chunks(spark, sf_dir)
    return lc.rebalance(c, w, F.lit(AS_OF).cast("timestamp"), 12 * 3600)


@query(f"WITH {_CHUNKS} SELECT job, count(*) AS chunks, count(*) FILTER (status = 'completed') AS done, count(*) = count(*) FILTER (status = 'completed') AS complete FROM c GROUP BY job")
def job_completion(spark, sf_dir):
    return lc.jobs_complete(_chunks(spark, sf_dir)[0])


@query(f"WITH {_CHUNKS} SELECT worker, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'assigned') AS assigned, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM c GROUP BY worker")
def chunk_status_counts(spark, sf_dir):
    c = _chunks(spark, sf_dir)[0]
    return c.groupBy("worker").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "assigned", "completed", "failed")])


@query("SELECT created_by AS worker, count(*) FILTER (status = 'completed') AS scans, count(*) FILTER (status = 'failed') AS failures, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS busy_ms FROM scan_jobs GROUP BY 1")
def worker_counters(spark, sf_dir):
    s = F.col("status")
    j = table(spark, sf_dir, "scan_jobs")
    return j.groupBy(F.col("created_by").alias("worker")).agg(F.count_if(s == "completed").alias("scans"), F.count_if(s == "failed").alias("failures"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("busy_ms"))


@query("SELECT count(DISTINCT user_id) FILTER (last >= 3) AS active, count(DISTINCT user_id) FILTER (last < 3) AS idle, count(*) AS connections FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS last FROM events GROUP BY user_id)")
def pool_counts(spark, sf_dir):
    """Connections of a pool: those with three requests or more are active, the rest idle."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"))
    return per.agg(F.count_if(F.col("n") >= 3).alias("active"), F.count_if(F.col("n") < 3).alias("idle"), F.count(F.lit(1)).alias("connections"))


# --- queues, caches -------------------------------------------------------------------------------------------------


@query("""SELECT priority, count(*) FILTER (status = 'pending') AS queued, count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) AS finished, round(avg((epoch_us(started_at) - epoch_us(created_at)) / 1000.0::DOUBLE), 4) AS avg_wait_ms,
round(count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) / nullif((epoch_us(max(ended_at)) - epoch_us(min(started_at))) / 3600000000::DOUBLE, 0), 6) AS per_hour FROM scan_jobs GROUP BY priority""")
def queue_statistics(spark, sf_dir):
    return lc.queue_statistics(table(spark, sf_dir, "scan_jobs"))


@query("SELECT id, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, created_at NULLS LAST, id) AS place FROM scan_jobs WHERE status = 'pending'")
def dequeue_order(spark, sf_dir):
    return lc.dequeue_order(table(spark, sf_dir, "scan_jobs"))


_CACHE = "cache AS (SELECT asset_id AS key, count(*) AS hits, max(observed_at) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC) AS rn FROM findings) WHERE rn = 1 AND asset_id IS NOT NULL GROUP BY 1)"


@query(f"WITH {_CACHE} SELECT key, place FROM (SELECT key, row_number() OVER (ORDER BY hits, seen, key) AS place FROM cache) WHERE place <= (SELECT greatest(0, count(*) - 500) FROM cache)")
def cache_evictions(spark, sf_dir):
    """A cache of findings by asset that keeps 500 entries: what has to go, least used and oldest first."""
    f = latest_delivery(table(spark, sf_dir, "findings"), "finding_id", "ingested_at", {"asset_id": "asset_id", "observed_at": "observed_at"})
    cache = f.where("asset_id IS NOT NULL").groupBy(F.col("asset_id").alias("key")).agg(F.count(F.lit(1)).alias("hits"), F.max("observed_at").alias("at"))
    return lc.evictions(cache, 500)


@query("WITH s AS (" + operations_queries.ORACLE["cache_validity"] + ") SELECT count(*) FILTER (state = 'hit') AS hits, count(*) FILTER (state <> 'hit') AS misses, round(count(*) FILTER (state = 'hit') / count(*)::DOUBLE, 6) AS hit_rate FROM s")
def cache_hit_rate(spark, sf_dir):
    s = operations_queries.cache_validity(spark, sf_dir).agg(F.count_if(F.col("state") == "hit").alias("hits"), F.count_if(F.col("state") != "hit").alias("misses"))
    return s.withColumn("hit_rate", F.round(F.try_divide("hits", F.col("hits") + F.col("misses")), 6))


# --- schedules: jobs stand for schedules ----------------------------------------------------------------------------

_SCHED = """s AS (SELECT id, CASE WHEN type = 'scan' THEN 'interval' ELSE 'once' END AS kind, status <> 'cancelled' AS enabled, status = 'running' AS running, 
  CASE WHEN status IN ('completed', 'failed') THEN status END AS last_status, epoch(created_at)::BIGINT AS start, floor(epoch(ended_at))::BIGINT AS last FROM (SELECT * REPLACE (date_trunc('second', created_at) AS created_at, date_trunc('second', ended_at) AS ended_at) FROM scan_jobs)),
n AS (SELECT *, CASE WHEN kind = 'once' THEN CASE WHEN last IS NULL THEN greatest(start, 1764547200) END WHEN last IS NULL AND start >= 1764547200 THEN start
  ELSE coalesce(last, start) + greatest(ceil((1764547200 - coalesce(last, start)) / 86400.0), 1)::BIGINT * 86400 END AS next FROM s)"""
_NOW = "2025-12-01 00:00:00"  # 1764547200


def _schedules(spark, sf_dir):
    j = table(spark, sf_dir, "scan_jobs")
    at = lambda c: F.date_trunc("second", F.col(c).cast("timestamp"))
    s = j.select(
        "id", F.when(F.col("type") == "scan", "interval").otherwise("once").alias("kind"), (F.col("status") != "cancelled").alias("enabled"), (F.col("status") == "running").alias("running"),
        F.when(F.col("status").isin("completed", "failed"), F.col("status")).alias("last_status"), at("created_at").alias("start"), at("ended_at").alias("last"),
    )
    none = F.lit(None).cast("timestamp")
    nxt = lc.next_run(F.col("kind"), none, F.lit(86_400).cast("bigint"), F.col("last"), F.col("start"), none, F.lit(_NOW).cast("timestamp"))
    return s.withColumn("next", F.unix_seconds(nxt))


@query(f"WITH {_SCHED} SELECT id, next FROM n WHERE enabled")
def next_schedules(spark, sf_dir):
    """When each enabled schedule runs next, daily ones by interval, the others once."""
    return _schedules(spark, sf_dir).where("enabled").select("id", "next")


@query(f"WITH {_SCHED} SELECT id, row_number() OVER (ORDER BY next NULLS LAST, id) AS place FROM n WHERE enabled AND NOT running AND next <= 1764547200 + 86400")
def due_schedules(spark, sf_dir):
    """Enabled schedules due within a day that aren't running, the next first."""
    from ..operators.ordering import numbered

    due = _schedules(spark, sf_dir).where(f"enabled AND NOT running AND next <= unix_seconds(timestamp'{_NOW}') + 86400").select("id", "next")
    return numbered(due, [F.asc_nulls_last("next"), "id"], "place").select("id", "place")


@query(f"WITH {_SCHED} SELECT count(*) FILTER (enabled) AS enabled, count(*) FILTER (running) AS running, count(*) FILTER (last_status = 'completed' AND last >= 1764547200 - 86400 AND last < 1764547200) AS completed_today, count(*) FILTER (last_status = 'failed' AND last >= 1764547200 - 86400 AND last < 1764547200) AS failed_today, min(next) FILTER (enabled) AS next FROM n")
def scheduler_statistics(spark, sf_dir):
    """Counts over all schedules; the day is the one before the reference time."""
    s, last = _schedules(spark, sf_dir), F.unix_seconds("last")
    now = F.unix_seconds(F.lit(_NOW).cast("timestamp"))
    today = (last >= now - 86_400) & (last < now)
    return s.agg(
        F.count_if("enabled").alias("enabled"), F.count_if("running").alias("running"), F.count_if(today & (F.col("last_status") == "completed")).alias("completed_today"),
        F.count_if(today & (F.col("last_status") == "failed")).alias("failed_today"), F.min(F.when(F.col("enabled"), F.col("next"))).alias("next"),
    )


@query("SELECT id, CAST(a AS INTEGER) AS attempt, a * 1.5::DOUBLE AS delay_s FROM scan_jobs, (SELECT unnest([1, 2]) AS a) WHERE status = 'failed'")
def retry_plan(spark, sf_dir):
    return lc.retry_plan(table(spark, sf_dir, "scan_jobs").where("status = 'failed'"), "id", 1.5, 2)


# --- targets --------------------------------------------------------------------------------------------------------


@query(W + "SELECT id, 'zones' AS kind FROM inv WHERE zone IN ('dmz', 'mgmt') UNION ALL SELECT id, 'tags' FROM inv WHERE list_has_any(services, ['ssh', 'rdp']) UNION ALL SELECT id, 'query' FROM inv WHERE criticality >= 4 AND internet_facing")
def schedule_targets(spark, sf_dir):
    """The targets of three kinds of schedules: by zones, by tags, by a predicate."""
    i = inv(spark, sf_dir, "zone", "services", "criticality", "internet_facing")
    picks = [lc.select_targets(i, "zones", ("dmz", "mgmt")), lc.select_targets(i, "tags", ("ssh", "rdp")), lc.select_targets(i, "query", query="criticality >= 4 AND internet_facing")]
    a, b, c = (x.select("id", F.lit(k).alias("kind")) for x, k in zip(picks, ("zones", "tags", "query")))
    return a.unionByName(b).unionByName(c)


@query(W + ", alive AS (SELECT DISTINCT asset_id AS id FROM findings WHERE observed_at >= '2025-09-01') SELECT id, id IN (SELECT id FROM alive WHERE id IS NOT NULL) AS success, CASE WHEN id IN (SELECT id FROM alive WHERE id IS NOT NULL) THEN NULL ELSE 'unreachable' END AS error FROM inv")
def reachable_targets(spark, sf_dir):
    """Targets seen since September are reachable, the others are appended as failures."""
    seen = table(spark, sf_dir, "findings").where(F.col("observed_at") >= F.lit("2025-09-01").cast("timestamp")).select(F.col("asset_id").alias("id")).where("id IS NOT NULL")
    return lc.with_unreachable(inv(spark, sf_dir, "criticality").select("id"), seen, "id")


@query(W + ", b AS (SELECT asset_id, arg_max(struct_pack(o := observed_at, f := finding_id, s := scanner), struct_pack(o := observed_at, f := finding_id)) AS b FROM findings WHERE asset_id IS NOT NULL GROUP BY 1) SELECT id, b.f AS finding_id, b.s AS scanner FROM inv LEFT JOIN b ON b.asset_id = id")
def target_results(spark, sf_dir):
    """Every target with its latest result."""
    f = table(spark, sf_dir, "findings").select(F.col("asset_id").alias("id"), "observed_at", "finding_id", "scanner")
    return lc.update_targets(inv(spark, sf_dir, "criticality").select("id"), f, "id", ["observed_at", "finding_id"], ["finding_id", "scanner"])


@query(W + "SELECT id, 'M001' AS misconfig_id, 'high' AS severity FROM inv WHERE list_contains(services, 'ssh') AND internet_facing UNION ALL SELECT id, 'M019', 'medium' FROM inv WHERE NOT domain_joined")
def config_detections(spark, sf_dir):
    """Simple detections over configuration texts made from an asset's flags."""
    i = inv(spark, sf_dir, "services", "internet_facing", "domain_joined")
    sshd = F.when(F.array_contains("services", "ssh") & F.col("internet_facing"), "Port 22\nPermitRootLogin yes").otherwise("PermitRootLogin no")
    fw = F.when(F.col("domain_joined"), "Status: active").otherwise("Status: inactive")
    return lc.config_findings(i.select("id", sshd.alias("sshd"), fw.alias("fw")), "id", "sshd", "fw")


@query(W + "SELECT id, CASE WHEN list_contains(services, 'winrm') THEN 'windows' ELSE 'linux' END AS platform FROM inv")
def platforms(spark, sf_dir):
    i = inv(spark, sf_dir, "services")
    return i.select("id", lc.platform(F.when(F.array_contains("services", "winrm"), 5985).otherwise(22)).alias("platform"))


_COARSE = fixed.values([(a, b) for a, bs in fixed.groups(fixed.ZONE_REACH_COARSE) for b in bs], "r", "a, b")
_kind_of = "CASE WHEN zone IN ('dmz', 'restricted', 'airgap') THEN zone WHEN starts_with(zone, 'cloud') THEN 'cloud' WHEN zone = 'unknown' THEN 'unknown' ELSE 'internal' END"


@query(W + f", k AS (SELECT DISTINCT {_kind_of} AS kind FROM inv) SELECT x.kind AS source, y.kind AS target, EXISTS (SELECT 1 FROM {_COARSE} WHERE r.a = x.kind AND r.b = y.kind) AS reaches FROM k x, k y")
def coarse_reachability(spark, sf_dir):
    """Which kinds of zones of the inventory reach which, by the short list."""
    kind = F.when(F.col("zone").isin("dmz", "restricted", "airgap", "unknown"), F.col("zone")).when(F.startswith("zone", F.lit("cloud")), "cloud").otherwise("internal")
    k = inv(spark, sf_dir, "zone").select(kind.alias("kind")).distinct()
    all_ = k.agg(F.collect_set("kind").alias("all"))  # at most six
    rows = k.crossJoin(F.broadcast(all_)).select(F.col("kind").alias("source"), F.explode("all").alias("target"))
    return rows.withColumn("reaches", lc.coarse_reach(F.col("source"), F.col("target")))
