"""Queries over zones, validation, jobs, events and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..operators import edges, embedding as em, jobs, validation as va, zones
from ..operators.delivery import latest_delivery
from ..operators.ordering import chunked
from ..session import materialise, table
from ..streaming import scan_events as st
from . import sql
from .inventory_queries import SCORED, inv

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2025-12-31 00:00:00"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# --- zones ----------------------------------------------------------------------------------------------------

W = sql.with_(*sql.BASE)
_ip = "(CASE WHEN regexp_full_match(trim(ip), '\\d{1,3}(\\.\\d{1,3}){3}') AND len(list_filter(list_transform(string_split(trim(ip), '.'), lambda p: p::INTEGER), lambda p: p > 255)) = 0 THEN list_reduce(list_transform(string_split(trim(ip), '.'), lambda p: p::BIGINT), lambda a, p: a * 256 + p) END)"


def _case(kind: str, test, what: int) -> str:
    arms = " ".join(f"WHEN {test(p)} THEN {fixed.quoted(z) if what == 0 else f'{c}::DOUBLE'}" for _, p, z, c in fixed.zone_rules(kind))
    return f"(CASE {arms} END)"


def _between(p: str) -> str:
    lo, hi = fixed.cidr_range(p)
    return f"n BETWEEN {lo} AND {hi}"


@query("WITH RECURSIVE " + sql.REACH.replace("reach AS", "r AS") + ", w AS (SELECT rs, rt, CASE WHEN rs = rt THEN 0 ELSE 1 END AS d FROM r UNION SELECT w.rs, r.rt, d + 1 FROM w JOIN r ON w.rt = r.rs WHERE d < 20 AND r.rs <> r.rt) SELECT rs AS src, rt AS tgt, min(d) AS dist FROM w GROUP BY ALL")
def zone_distance_matrix(spark, sf_dir):
    rows = [(a, b, d) for (a, b), d in fixed.zone_distances().items()]
    return spark.createDataFrame(rows, "src string, tgt string, dist int")


@query(W + f"SELECT id, {_ip} AS n FROM inv")
def ip_numbers(spark, sf_dir):
    return inv(spark, sf_dir, "ip").select("id", zones.ip_number(F.col("ip")).alias("n"))


@query(W + f"SELECT id, {_case('cidr', _between, 0)} AS zone, {_case('cidr', _between, 1)} AS confidence FROM (SELECT id, {_ip} AS n FROM inv) WHERE {_case('cidr', _between, 0)} IS NOT NULL")
def cidr_match(spark, sf_dir):
    r = inv(spark, sf_dir, "ip").select("id", zones.by_cidr(F.col("ip")).alias("r")).where("r IS NOT NULL")
    return r.select("id", "r.zone", "r.confidence")


@query(W + f""", h AS (SELECT id, lower(left(name, 3)) || '-' || lower(name) AS host, {_ip} AS n, list_transform(services, lambda s: CASE s WHEN 'sql' THEN 'sql-server' WHEN 'http' THEN 'nginx' WHEN 'kerberos' THEN 'active-directory' ELSE s END) AS sv FROM inv),
e AS (SELECT id, 0 AS k, {_case('cidr', _between, 0)} AS zone, {_case('cidr', _between, 1)} AS c FROM h
  UNION ALL SELECT id, 1, {_case('hostname', lambda p: f"regexp_matches(host, '(?i){p}')", 0)}, {_case('hostname', lambda p: f"regexp_matches(host, '(?i){p}')", 1)} FROM h
  UNION ALL SELECT id, 2, zone, c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, turn) AS rn FROM (
    SELECT id, r.zone, min(r.o) AS turn, count(*) * sum(r.c) AS score, round(sum(r.c) / count(*), 9) AS c FROM (SELECT id, unnest(sv) AS s FROM h)
    JOIN {fixed.values([(i, p, z, c) for i, p, z, c in fixed.zone_rules('service')], 'r', 'o, p, zone, c')} ON contains(lower(s), r.p) GROUP BY id, r.zone)) WHERE rn = 1),
t AS (SELECT id, zone, round(sum(c), 9) AS total, min(k) AS k FROM e WHERE zone IS NOT NULL GROUP BY id, zone),
n AS (SELECT id, count(*) AS evidences FROM e WHERE zone IS NOT NULL GROUP BY id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY total DESC, k) AS rn FROM t) WHERE rn = 1)
SELECT i.id, coalesce(b.zone, 'unknown') AS zone, round(CASE WHEN evidences > 0 THEN least(1, b.total / evidences) ELSE 0 END, 6) AS confidence, coalesce(evidences, 0) AS evidences FROM inv i LEFT JOIN b ON b.id = i.id LEFT JOIN n ON n.id = i.id""")
def zone_detection(spark, sf_dir):
    known = {"sql": "sql-server", "http": "nginx", "kerberos": "active-directory"}

    def product(s):
        out = s
        for k, v in known.items():
            out = F.when(s == k, v).otherwise(out)
        return out

    hosts = inv(spark, sf_dir, "ip", "name", "services").select("id", "ip", F.concat(F.lower(F.left("name", F.lit(3))), F.lit("-"), F.lower("name")).alias("host"), F.transform("services", product).alias("services"))
    return zones.detect(hosts, "id", "ip", "host", "services").withColumn("confidence", F.round("confidence", 6))


@query(W + "SELECT CASE WHEN ip LIKE '192.168.0.%' OR ip LIKE '10.0.0.%' THEN 'dmz' WHEN ip LIKE '10.1.%' OR ip LIKE '10.2.%' OR ip LIKE '172.20.%' THEN 'internal' WHEN ip LIKE '10.10.%' OR ip LIKE '10.100.%' THEN 'restricted' ELSE 'internal' END AS zone, count(*) AS n FROM inv GROUP BY 1")
def prefix_zones(spark, sf_dir):
    return inv(spark, sf_dir, "ip").groupBy(zones.by_prefix(F.col("ip")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


_ADDRESS = {1: "10.0.0.9", 2: "10.1.2.3", 3: "10.100.7.1", 4: "192.168.0.4", 5: "10.255.0.1"}
_VLAN = {"pii": 20, "credentials": 501, "financial": 101, "user_files": 900}
_PROVIDER = {"cloud-prod": "AWS eu", "cloud-dev": "Azure"}
_RULE = """, h AS (SELECT id, {ip} AS n, {vlan} AS vlan, {cloud} AS cloud FROM inv),
e AS (SELECT id, 0 AS k, {cidr_zone} AS zone, {cidr_c} AS c FROM h
  UNION ALL SELECT id, 1, CASE {vlans} END, 0.85::DOUBLE FROM h UNION ALL SELECT id, 4, {cloud_zone}, {cloud_c} FROM h),
t AS (SELECT id, zone, round(sum(c), 9) AS total, min(k) AS k FROM e WHERE zone IS NOT NULL GROUP BY id, zone),
n AS (SELECT id, count(*) AS evidences FROM e WHERE zone IS NOT NULL GROUP BY id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY total DESC, k) AS rn FROM t) WHERE rn = 1)
SELECT i.id, coalesce(b.zone, 'unknown') AS zone, round(CASE WHEN evidences > 0 THEN least(1, b.total / evidences) ELSE 0 END, 6) AS confidence, coalesce(evidences, 0) AS evidences FROM inv i LEFT JOIN b ON b.id = i.id LEFT JOIN n ON n.id = i.id"""
_hit = lambda p: f"contains(lower(cloud), '{p}')"


@query(W + _RULE.format(
    ip=fixed.sql_case("criticality", {k: fixed.cidr_range(a + "/32")[0] for k, a in _ADDRESS.items()}, 0), vlan=fixed.sql_case("sensitivity", _VLAN, 0), cloud=fixed.sql_case("zone", _PROVIDER, ""),
    cidr_zone=_case("cidr", _between, 0), cidr_c=_case("cidr", _between, 1), cloud_zone=_case("cloud", _hit, 0), cloud_c=_case("cloud", _hit, 1),
    vlans=" ".join(f"WHEN vlan IN ({', '.join(ids)}) THEN '{z}'" for z, ids in fixed.groups(fixed.VLANS)),
))
def rule_zones(spark, sf_dir):
    """Zone detection where every kind of rule hits: addresses, VLANs and providers made from an asset's other columns."""
    i = inv(spark, sf_dir, "criticality", "sensitivity", "zone")
    hosts = i.select(
        "id", fixed.switch(F.col("criticality"), _ADDRESS, "0.0.0.0").alias("ip"), F.lit(None).cast("string").alias("host"), F.array().cast("array<string>").alias("services"),
        fixed.switch(F.col("sensitivity"), _VLAN, 0).alias("vlan"), fixed.switch(F.col("zone"), _PROVIDER, "").alias("cloud"),
    )
    return zones.detect(hosts, "id", "ip", "host", "services", "vlan", "cloud").withColumn("confidence", F.round("confidence", 6))


# --- validation -----------------------------------------------------------------------------------------------

# findings as detections: every fourth finding of a category stands for one of the validation rules
_MAP = {"authentication": "VM008", "service": "VM016", "network": "VM019", "authorization": "VM010", "logging": "VM004", "encryption": "VM007"}
_DET = W + f""", d AS (SELECT asset_id, finding_id, {fixed.sql_case('category', _MAP, 'VM000')} AS mid, severity, i.name, CASE WHEN starts_with(i.zone, 'cloud') THEN 'cloud' ELSE i.zone END AS zone, list_contains(coalesce(i.services, []), 'agentd') AS agent, pos FROM fnd JOIN inv i ON i.id = asset_id),
v AS (SELECT asset_id, finding_id, mid, round(greatest(0, least(1, 0.5::DOUBLE
  + CASE WHEN mid = 'VM008' AND agent THEN -0.3::DOUBLE ELSE 0 END + CASE WHEN mid = 'VM008' AND pos % 2 = 0 THEN -0.2::DOUBLE ELSE 0 END
  + CASE WHEN mid = 'VM016' THEN CASE WHEN pos % 2 = 0 THEN -0.5::DOUBLE ELSE 0.2::DOUBLE END ELSE 0 END
  + CASE WHEN mid = 'VM019' AND agent THEN -0.5::DOUBLE ELSE 0 END + CASE WHEN mid = 'VM019' AND zone = 'cloud' THEN -0.2::DOUBLE ELSE 0 END
  + CASE WHEN mid = 'VM010' THEN CASE WHEN pos % 2 = 0 THEN -0.6::DOUBLE ELSE -0.2::DOUBLE END ELSE 0 END
  + CASE WHEN mid = 'VM004' AND agent THEN -0.4::DOUBLE ELSE 0 END
  + CASE WHEN mid = 'VM016' AND pos % 2 = 0 THEN -0.3::DOUBLE ELSE 0 END + CASE WHEN mid = 'VM010' AND pos % 2 = 0 THEN -0.3::DOUBLE ELSE 0 END)), 9) AS confidence FROM d)
"""


def _detections(spark, sf_dir):
    i = inv(spark, sf_dir, "zone", "services", "findings")
    even, agent = F.col("f.pos") % 2 == 0, F.array_contains("services", "agentd")
    row = i.select("id", "zone", "services", F.explode("findings").alias("f"))
    files = F.when(even, "/tmp/a t").otherwise("/opt/a")
    results = F.create_map(
        F.lit("sshd_config"), F.concat(F.when(agent, "PermitRootLogin prohibit-password\n").otherwise(""), F.when(even, "PasswordAuthentication no").otherwise("")),
        F.lit("suid_sgid"), F.when(even, "/usr/bin/sudo").otherwise("/opt/tool"), F.lit("world_writable"), files,
        F.lit("interfaces"), F.when(agent, "lo docker0").otherwise("lo"), F.lit("shadow"), F.when(agent, "guest:!:").otherwise("guest:x:"),
    )
    evidence = F.when((fixed.switch(F.col("f.category"), _MAP, "VM000") == "VM016"), F.when(even, "/usr/bin/sudo").otherwise("/opt/tool")).when(fixed.switch(F.col("f.category"), _MAP, "VM000") == "VM010", F.when(even, "/tmp/a").otherwise("/opt/a"))
    return row.select(
        F.col("id").alias("asset_id"), F.col("f.finding_id").alias("finding_id"), fixed.switch(F.col("f.category"), _MAP, "VM000").alias("misconfig_id"), F.lit(True).alias("detected"), evidence.alias("evidence"),
        F.lit("Linux").alias("os"), F.when(F.startswith("zone", F.lit("cloud")), "cloud").otherwise(F.col("zone")).alias("zone"), results.alias("raw"),
    )


@query(_DET + "SELECT asset_id, finding_id, mid AS misconfig_id, confidence, CASE WHEN confidence < 0.3 THEN 'high' WHEN confidence < 0.6 THEN 'medium' ELSE 'low' END AS risk, confidence >= 0.5 AS validated FROM v")
def finding_validation(spark, sf_dir):
    return va.validate(_detections(spark, sf_dir)).select("asset_id", "finding_id", "misconfig_id", "confidence", "risk", "validated")


@query(_DET + "SELECT count(*) AS total, count(*) FILTER (confidence >= 0.8) AS high_confidence, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium_confidence, count(*) FILTER (confidence < 0.5) AS low_confidence, count(*) FILTER (confidence < 0.5) AS suppressed, round(count(*) FILTER (confidence < 0.5) / count(*)::DOUBLE, 6) AS fp_rate FROM v")
def validation_statistics(spark, sf_dir):
    return va.statistics(va.validate(_detections(spark, sf_dir)))


@query(_DET + "SELECT asset_id, finding_id, confidence >= 0.5 AS kept, CASE WHEN confidence < 0.5 THEN format('confidence {:.2f} is below 0.50 (risk of a false positive: {})', confidence, CASE WHEN confidence < 0.3 THEN 'high' WHEN confidence < 0.6 THEN 'medium' ELSE 'low' END) END AS reason FROM v")
def suppressed_detections(spark, sf_dir):
    return va.kept_and_suppressed(va.validate(_detections(spark, sf_dir))).select("asset_id", "finding_id", "kept", "reason")


# --- jobs -----------------------------------------------------------------------------------------------------


@query("SELECT id, type, status, priority FROM scan_jobs WHERE status IN ('completed', 'failed') AND type IN ('scan', 'analyze') AND created_at BETWEEN '2025-02-01' AND '2025-10-31' ORDER BY created_at DESC, id LIMIT 50 OFFSET 20")
def job_list_page(spark, sf_dir):
    at = F.col("created_at").between(F.lit("2025-02-01").cast("timestamp"), F.lit("2025-10-31").cast("timestamp"))
    test = F.col("status").isin("completed", "failed") & F.col("type").isin("scan", "analyze") & at
    return jobs.page(table(spark, sf_dir, "scan_jobs"), test, 20, 50).select("id", "type", "status", "priority")


@query("SELECT type, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'cancelled') AS cancelled, round(avg(duration_ms) FILTER (status = 'completed'), 4) AS avg_duration, round(avg(date_diff('millisecond', created_at, started_at)), 4) AS avg_wait FROM scan_jobs GROUP BY type")
def job_statistics(spark, sf_dir):
    s = F.col("status")
    wait = F.unix_millis("started_at") - F.unix_millis("created_at")
    return table(spark, sf_dir, "scan_jobs").groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(s == x).alias(x) for x in ("completed", "failed", "running", "pending", "cancelled")],
        F.round(F.avg(F.when(s == "completed", F.col("duration_ms"))), 4).alias("avg_duration"), F.round(F.avg(wait), 4).alias("avg_wait"),
    )


FINDINGS = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC) AS rn FROM findings) WHERE rn = 1)"


def _findings(spark, sf_dir, *columns):
    return latest_delivery(table(spark, sf_dir, "findings"), "finding_id", "ingested_at", {c: c for c in columns})


@query(f"WITH {FINDINGS} SELECT job_id, count(*) AS findings, count(DISTINCT asset_id) AS assets, count(*) FILTER (lower(trim(severity)) = 'critical') AS critical, count(*) FILTER (lower(trim(severity)) = 'high') AS high FROM f WHERE job_id IS NOT NULL GROUP BY job_id")
def job_findings(spark, sf_dir):
    sev = F.lower(F.trim("severity"))
    f = _findings(spark, sf_dir, "job_id", "asset_id", "severity").where("job_id IS NOT NULL")
    # per job and asset first, so that counting distinct assets needs no second copy of the rows
    per = f.groupBy("job_id", "asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(sev == "critical").alias("c"), F.count_if(sev == "high").alias("h"))
    return per.groupBy("job_id").agg(F.sum("n").alias("findings"), F.count("asset_id").alias("assets"), F.sum("c").alias("critical"), F.sum("h").alias("high"))


@query(f"WITH {FINDINGS} SELECT j.id, j.type, j.status, count(DISTINCT f.asset_id) AS targets, count(f.finding_id) AS results FROM scan_jobs j LEFT JOIN f ON f.job_id = j.id GROUP BY ALL")
def job_list_counts(spark, sf_dir):
    """Every job with the number of its targets and of its results."""
    per = job_findings(spark, sf_dir).select(F.col("job_id").alias("id"), F.col("assets").alias("targets"), F.col("findings").alias("results"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, sf_dir, "scan_jobs").select("id", "type", "status").join(per, "id", "left").select("id", "type", "status", zero("targets"), zero("results"))


@query(W + """SELECT id, list_contains(coalesce(services, []), 'agentd') AS is_container, domain_joined AS is_vm, criticality >= 4 AS is_hardened, internet_facing AS firewall_active,
  array_to_string(list_filter(list_transform(coalesce(services, []), lambda s: trim(s)), lambda s: s <> ''), ',') AS services, CASE WHEN internet_facing THEN '22,443' ELSE '22' END AS ports FROM inv""")
def host_contexts(spark, sf_dir):
    """What raw collector results, made from an asset's columns, say about its host."""
    i = inv(spark, sf_dir, "services", "domain_joined", "criticality", "internet_facing")
    raw = F.create_map(
        F.lit("interfaces"), F.when(F.array_contains("services", "agentd"), "lo veth0").otherwise("lo"), F.lit("dmi"), F.when(F.col("domain_joined"), "VMware").otherwise("Bare"),
        F.lit("sshd_config"), F.when(F.col("criticality") >= 4, "SELINUX=enforcing").otherwise(""), F.lit("firewall_ufw"), F.when(F.col("internet_facing"), "Status: active").otherwise("Status: inactive"),
        F.lit("services"), F.array_join("services", " ,\n"), F.lit("listening"), F.when(F.col("internet_facing"), "0.0.0.0:22 0.0.0.0:443 :::22").otherwise("0.0.0.0:22"),
    )
    c = va.context(i.select("id", raw.alias("raw")))
    return c.select("id", "is_container", "is_vm", "is_hardened", "firewall_active", F.array_join("services", ",").alias("services"), F.array_join(F.transform("ports", lambda p: p.cast("string")), ",").alias("ports"))


@query(f"WITH {FINDINGS} SELECT j.status, j.type, count(*) AS findings FROM f JOIN scan_jobs j ON j.id = f.job_id GROUP BY ALL")
def findings_by_job_state(spark, sf_dir):
    per = _findings(spark, sf_dir, "job_id").where("job_id IS NOT NULL").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, sf_dir, "scan_jobs")
    return per.join(j, per.job_id == j.id).groupBy("status", "type").agg(F.sum("n").alias("findings"))


@query("SELECT id FROM scan_jobs WHERE id NOT IN (SELECT job_id FROM findings WHERE job_id IS NOT NULL) AND status = 'completed'")
def jobs_without_findings(spark, sf_dir):
    seen = table(spark, sf_dir, "findings").select(F.col("job_id").alias("id"))
    return table(spark, sf_dir, "scan_jobs").where("status = 'completed'").join(seen, "id", "left_anti").select("id")


@query("SELECT id FROM scan_jobs WHERE id IN (SELECT job_id FROM findings) AND status <> 'completed'")
def unfinished_jobs_with_findings(spark, sf_dir):
    seen = table(spark, sf_dir, "findings").select(F.col("job_id").alias("id"))
    return table(spark, sf_dir, "scan_jobs").where("status <> 'completed'").join(seen, "id", "left_semi").select("id")


@query("SELECT asset_id, finding_id FROM (SELECT DISTINCT asset_id, misconfig_id AS finding_id FROM findings WHERE scanner = 'sweep-a' INTERSECT SELECT DISTINCT asset_id, misconfig_id FROM findings WHERE scanner = 'sweep-b')")
def confirmed_by_both_scanners(spark, sf_dir):
    f = table(spark, sf_dir, "findings")
    a, b = (f.where(F.col("scanner") == s).select("asset_id", F.col("misconfig_id").alias("finding_id")) for s in ("sweep-a", "sweep-b"))
    return a.intersect(b)


_prio = f"""CAST(floor({fixed.sql_case("sev", jobs.BASE, 0)} + {fixed.sql_case("split_part(zone, '-', 1)", jobs.ZONE, 0)} + criticality * 20 + (CASE WHEN internet_facing THEN 40 ELSE 0 END)
  + (CASE WHEN revenue > 0 THEN log10(revenue) * 0.00001::DOUBLE ELSE 0 END) + (CASE sensitivity WHEN 'pii' THEN 30 WHEN 'credentials' THEN 50 ELSE 0 END) + 0.5) AS BIGINT)"""


@query(W + f"SELECT id, {_prio} AS priority FROM (SELECT i.*, (SELECT severity FROM fnd WHERE asset_id = i.id ORDER BY (CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) DESC, pos LIMIT 1) AS sev FROM inv i)")
def task_priorities(spark, sf_dir):
    from ..operators.inventory import top_finding

    t = top_finding(inv(spark, sf_dir, "zone", "criticality", "internet_facing", "revenue", "sensitivity", "findings"))
    data = F.when(F.col("sensitivity") == "pii", "confidential").when(F.col("sensitivity") == "credentials", "restricted").otherwise("public")
    p = jobs.priority(F.col("top.severity"), F.substring_index("zone", "-", 1), F.col("criticality"), F.col("internet_facing"), F.col("revenue"), data, F.lit(0), F.lit(0))
    return t.select("id", p.alias("priority"))


@query(W + "SELECT chunk, count(*) AS n, min(id) AS first, max(id) AS last FROM (SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 50) AS BIGINT) AS chunk FROM inv) GROUP BY chunk")
def chunk_plan(spark, sf_dir):
    c = chunked(inv(spark, sf_dir, "criticality").select("id"), ["id"], 50)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


_WORKERS = [(f"w{i:02d}", "busy" if i % 4 == 1 else "offline" if i % 7 == 6 else "idle", 2 + i % 3, i % 3) for i in range(24)]


@query(f"""WITH w AS (SELECT *, sum(room) OVER (ORDER BY load / capacity::DOUBLE, worker ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT *, greatest(capacity * 2 - load, 0) AS room FROM {fixed.values(_WORKERS, 'v', 'worker, status, capacity, load')}
WHERE status NOT IN ('offline', 'error') AND load < capacity)), c AS (SELECT id AS chunk, row_number() OVER (ORDER BY id) AS n FROM scan_jobs WHERE status = 'pending')
SELECT chunk, worker FROM c LEFT JOIN w ON n > upto - room AND n <= upto""")
def load_balance(spark, sf_dir):
    w = spark.createDataFrame(_WORKERS, "worker string, status string, capacity int, load int")
    pending = table(spark, sf_dir, "scan_jobs").where("status = 'pending'").select(F.col("id").alias("chunk"))
    return jobs.fill_first(pending, w)


@query(W + "SELECT id, CASE WHEN g IS NULL THEN 'miss' WHEN g <> h THEN 'changed' WHEN age > 7776000 THEN 'stale' ELSE 'hit' END AS state FROM (SELECT i.id, i.type || ':' || i.zone AS h, f.g, CAST(epoch(TIMESTAMP '2025-12-31') AS BIGINT) - CAST(floor(epoch(f.at_)) AS BIGINT) AS age FROM inv i LEFT JOIN (SELECT id, min(coalesce(type, 'unknown') || ':' || coalesce(zone, 'unknown')) AS g, min(observed_at) AS at_ FROM assets WHERE internet_facing GROUP BY id) f ON f.id = i.id)")
def cache_validity(spark, sf_dir):
    h = lambda: F.concat_ws(":", F.coalesce("type", F.lit("unknown")), F.coalesce("zone", F.lit("unknown")))
    cached = table(spark, sf_dir, "assets").where("internet_facing").groupBy("id").agg(F.min(h()).alias("hash"), F.min("observed_at").alias("cached_at"))
    return jobs.cache_state(cached, inv(spark, sf_dir, "type", "zone").select("id", h().alias("hash")), "id", F.lit(AS_OF).cast("timestamp"), 90 * 86_400)


_SLOTS = [h * 60 + m for h in (2, 14) for m in (0, 15, 30, 45)]


@query(f"""SELECT id, min(t) AS next_run FROM (
  SELECT id, created_at::TIMESTAMP AS c, date_trunc('day', created_at::TIMESTAMP) + INTERVAL (k) DAY + INTERVAL (m) MINUTE AS t
  FROM scan_jobs, (SELECT unnest(range(0, 10)) AS k), (SELECT unnest({_SLOTS}) AS m) WHERE status = 'pending')
WHERE t > c AND dayofweek(t) IN (1, 3, 5) GROUP BY id""")
def next_runs(spark, sf_dir):
    """The next run of pending jobs on '*/15 2,14 * * 1,3,5'."""
    rows = table(spark, sf_dir, "scan_jobs").where("status = 'pending'")
    return rows.select("id", jobs.next_cron("*/15 2,14 * * 1,3,5", F.col("created_at").cast("timestamp")).cast("timestamp_ntz").alias("next_run"))


@query("SELECT created_by, max(created_at)::TIMESTAMP AS seen, max(created_at)::TIMESTAMP < TIMESTAMP '2025-12-31 00:00:00' - INTERVAL 30 DAY AS stale FROM scan_jobs GROUP BY created_by")
def stale_sources(spark, sf_dir):
    """Heartbeats: the last sign of each source, stale after thirty days before the reference time."""
    s = table(spark, sf_dir, "scan_jobs").groupBy("created_by").agg(F.max(F.col("created_at").cast("timestamp")).alias("seen"))
    return s.select("created_by", F.col("seen").cast("timestamp_ntz").alias("seen"), (F.col("seen") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 30 DAYS")).alias("stale"))


# --- events ---------------------------------------------------------------------------------------------------

_kind = fixed.sql_case("event_type", st.KINDS, "other")
EV = f"WITH ev AS (SELECT event_id, ts, {_kind} AS kind, user_id % 10 AS job, user_id % 5 AS zone, value AS duration FROM events)\n"


def ev(spark, sf_dir):
    return st.scan_events(table(spark, sf_dir, "events"))


def ntz(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(EV + "SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (kind = 'target_error') AS errors, count(*) FILTER (kind = 'timeout') AS timeouts FROM ev GROUP BY 1")
def tumbling_counts(spark, sf_dir):
    return ntz(st.tumbling(ev(spark, sf_dir)))


@query(EV + "SELECT h - INTERVAL (k) HOUR AS start, CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS errors FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(*) FILTER (kind = 'target_error') AS e FROM ev GROUP BY 1), (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY 1")
def sliding_rates(spark, sf_dir):
    return ntz(st.sliding(ev(spark, sf_dir)))


@query(EV + "SELECT start, n, CAST(sum(n) OVER (ORDER BY start RANGE BETWEEN INTERVAL 4 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM (SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM ev GROUP BY 1)")
def trailing_counts(spark, sf_dir):
    """Each hour with the five hours up to it. The hours are spread by day; each day's windows see the day before."""
    h = st.tumbling(ev(spark, sf_dir)).select("start", "n")
    s = F.unix_seconds("start")
    day = F.floor(s / 86_400)
    both = h.select(F.explode(F.array(F.struct(day.alias("day"), F.lit(True).alias("own")), F.struct((day + 1).alias("day"), F.lit(False).alias("own")))).alias("d"), "start", "n", s.alias("s")).select("d.*", "start", "n", "s")
    w = Window.partitionBy("day").orderBy("s").rangeBetween(-4 * 3600, 0)
    return ntz(both.withColumn("trailing", F.sum("n").over(w)).where("own").select("start", "n", "trailing"))


@query(EV + "SELECT job, count(*) FILTER (kind = 'target_complete') AS completed, count(*) FILTER (kind = 'target_error') AS failed, round(avg(duration) FILTER (kind = 'target_complete' AND duration > 0), 6) AS avg_duration FROM ev GROUP BY job")
def job_progress(spark, sf_dir):
    return st.job_progress(ev(spark, sf_dir))


@query(EV + "SELECT job, zone, count(*) AS scanned, round(sum(duration), 4) AS total FROM ev WHERE kind IN ('target_complete', 'target_error') GROUP BY ALL")
def job_zone_statistics(spark, sf_dir):
    return st.job_zones(ev(spark, sf_dir))


@query(EV + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY job ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY ts) AS sid FROM g)
SELECT job, min(ts) AS start, count(*) AS n FROM s GROUP BY job, sid""")
def job_sessions(spark, sf_dir):
    return ntz(st.sessions(ev(spark, sf_dir)).select("job", "start", "n"))


_AIMD = EV + """, w AS (SELECT job, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, count(*) AS n, count(*) FILTER (kind = 'target_error') AS e, count(*) FILTER (kind = 'timeout') AS o FROM ev GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t) AS i FROM w),
r AS (SELECT DISTINCT job, 0::BIGINT AS i, 20 AS rate, -1000000000::BIGINT AS err, -1000000000::BIGINT AS adj, 0 AS cuts, 0 AS raises FROM q
  UNION ALL SELECT job, i, CASE WHEN cut THEN greatest(1, rate // 2) WHEN up THEN least(100, rate + 2) ELSE rate END, err, CASE WHEN cut OR up THEN t ELSE adj END, cuts + cut::INT, raises + up::INT FROM (
    SELECT *, n >= 10 AND NOT cut AND t - err > 5 AND t - adj > 5 AS up FROM (
      SELECT r.job, q.i, r.rate, q.t, q.n, r.adj, r.cuts, r.raises, CASE WHEN e > 0 THEN t ELSE r.err END AS err, n >= 10 AND (e / n::DOUBLE > 0.1 OR o / n::DOUBLE > 0.05) AS cut FROM r JOIN q ON q.job = r.job AND q.i = r.i + 1)))
SELECT job, rate, cuts, raises FROM r QUALIFY row_number() OVER (PARTITION BY job ORDER BY i DESC) = 1"""


@query(_AIMD.replace("WITH ev", "WITH RECURSIVE ev"))
def adaptive_rates(spark, sf_dir):
    e = ev(spark, sf_dir).withColumn("t", F.floor(F.unix_seconds("ts") / 3600).cast("bigint"))
    w = e.groupBy("job", "t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "target_error").alias("e"), F.count_if(F.col("kind") == "timeout").alias("o"))
    return jobs.aimd(w, "job", ["t"], ("n", "e", "o"))


@query((EV + """, q AS (SELECT user_id AS u, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE event_type = 'error'),
r AS (SELECT DISTINCT u, 0::BIGINT AS i, 2.0::DOUBLE AS lft, NULL::DOUBLE AS seen, 0 AS ok, 0 AS no FROM q
  UNION ALL SELECT u, i, CASE WHEN have >= 1 THEN have - 1 ELSE have END, t, ok + (have >= 1)::INT, no + (have < 1)::INT FROM (
    SELECT r.u, q.i, q.t, r.ok, r.no, least(2.0::DOUBLE, r.lft + coalesce(q.t - r.seen, 0) * 0.00001::DOUBLE) AS have FROM r JOIN q ON q.u = r.u AND q.i = r.i + 1))
SELECT u AS user_id, ok AS granted, no AS refused FROM r QUALIFY row_number() OVER (PARTITION BY u ORDER BY i DESC) = 1""").replace("WITH ev", "WITH RECURSIVE ev"))
def token_buckets(spark, sf_dir):
    """Error events only, as its SQL has it; ``request_buckets`` rations every event."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return buckets(e)


def buckets(events):
    """Every row of ``events`` takes a token of its user's bucket."""
    e = events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return jobs.token_bucket(e, "user_id", "t", 0.00001, 2)


@query(ORACLE["token_buckets"].replace(" FROM events WHERE event_type = 'error')", " FROM events)"))
def request_buckets(spark, sf_dir):
    """Every event of a user against the user's bucket, whatever its type."""
    return buckets(table(spark, sf_dir, "events"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_states(spark, sf_dir):
    return jobs.latest_state(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "ts"])


@query(ORACLE["tumbling_counts"])
def stream_tumbling_counts(spark, sf_dir):
    return ntz(st.run(st.tumbling(st.scan_events(st.read(spark, sf_dir))), "complete", "tumbling"))


@query(ORACLE["job_progress"])
def stream_job_progress(spark, sf_dir):
    return st.run(st.job_progress(st.scan_events(st.read(spark, sf_dir))), "complete", "progress")


@query(ORACLE["job_zone_statistics"])
def stream_job_zones(spark, sf_dir):
    return st.run(st.job_zones(st.scan_events(st.read(spark, sf_dir))), "complete", "zones")


@query(_AIMD.replace("WITH ev", "WITH RECURSIVE ev").replace("SELECT job, rate, cuts, raises", "SELECT job, rate"))
def stream_adaptive_rate(spark, sf_dir):
    return st.run(st.adaptive_rate(st.scan_events(st.read(spark, sf_dir))), "update", "rate", ["job"])


@query(ORACLE["sliding_rates"])
def stream_sliding_rates(spark, sf_dir):
    return ntz(st.run(st.sliding(st.scan_events(st.read(spark, sf_dir))), "update", "sliding", ["start"]))


@query(EV + """, m AS (SELECT max(ts) - INTERVAL 10 HOUR AS mark FROM ev WHERE event_id % 3 = 1)
SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (kind = 'target_error') AS errors, count(*) FILTER (kind = 'timeout') AS timeouts FROM ev, m
WHERE event_id % 3 > 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY 1""")
def stream_late_events(spark, sf_dir):
    """All events in three deliveries: what the last brings for windows closed ten hours before the latest event of the first is too late."""
    return ntz(st.run(st.tumbling(st.scan_events(st.deliveries(spark, sf_dir))), "update", "late", ["start"]))


@query(EV + "SELECT job, zone, count(*) AS scanned, count(*) FILTER (kind = 'target_error') AS findings, round(avg(event_id % 5 + 1), 6) AS avg_criticality FROM ev WHERE kind IN ('target_complete', 'target_error') GROUP BY ALL")
def job_zone_findings(spark, sf_dir):
    """Per job and zone: targets scanned, findings and the mean criticality of the targets."""
    return st.job_zone_findings(ev(spark, sf_dir))


@query(ORACLE["job_zone_findings"])
def stream_job_zone_findings(spark, sf_dir):
    return st.run(st.job_zone_findings(st.scan_events(st.read(spark, sf_dir))), "complete", "zone-findings")


def rate_histories(spark, sf_dir):
    """Adaptive rates under control events (a signup pauses, resumes, sets or resets by its value), the last 100 changes of each job."""
    e = ev(spark, sf_dir).withColumn("t", F.floor(F.unix_seconds("ts") / 3600).cast("bigint"))
    w = e.where("kind <> 'job_start'").groupBy("job", "t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "target_error").alias("e"), F.count_if(F.col("kind") == "timeout").alias("o"))
    what = F.floor(F.col("duration") * 7).cast("int") % 40
    c = e.where("kind = 'job_start'").select("job", "t", F.when(what == 0, "pause").when(what == 1, "resume").when(what == 2, "set").when(what == 3, "reset").alias("control"), F.lit(50).alias("value"))
    return jobs.controlled_rates(w, c.where("control IS NOT NULL").distinct(), "job", "t")


QUERIES["rate_histories"] = rate_histories


# --- embeddings -----------------------------------------------------------------------------------------------

_vec = "[" + ", ".join(
    [f"(type = '{t}')::INT::DOUBLE" for t in fixed.FEATURE_TYPES.split()] + ["criticality / 5::DOUBLE"] + [f"(zone = '{z}')::INT::DOUBLE" for z in fixed.FEATURE_ZONES.split()]
    + ["internet_facing::INT::DOUBLE", "domain_joined::INT::DOUBLE"]
    + [f"least((SELECT count(*) FROM fnd WHERE asset_id = inv.id AND severity = '{s}') / {k}::DOUBLE, 1)" for s, k in (("critical", 3), ("high", 5), ("medium", 10), ("low", 15))]
    + [fixed.sql_case("sensitivity", fixed.pairs_of(fixed.SENSITIVITY), 0.5)]
) + "]"


@query(W + f"SELECT id, array_to_string(list_transform({_vec}, lambda x: printf('%.4f', x)), ',') AS f FROM inv")
def feature_vectors(spark, sf_dir):
    return em.features(inv(spark, sf_dir)).select("id", F.array_join(F.transform("f", lambda x: F.format_string("%.4f", x)), ",").alias("f"))


_SIMILAR = sql.with_(sql.INV, sql.FND, f"vec AS (SELECT id, {_vec} AS v FROM inv)", *sql.GRAPH[2:]).replace(
    "AS common\n  FROM inv a", """* (1 + 0.3::DOUBLE * round(greatest(list_dot_product(va.v, vb.v) / 64 / (sqrt(list_dot_product(va.v, va.v)) * sqrt(list_dot_product(vb.v, vb.v)) / 64 + 1e-8), 0), 9)) AS common
  FROM inv a JOIN vec va ON va.id = a.id"""
).replace("JOIN inv b ON b.zone = r.rt WHERE a.id <> b.id)", "JOIN inv b ON b.zone = r.rt JOIN vec vb ON vb.id = b.id WHERE a.id <> b.id)")


@query(_SIMILAR + "SELECT profile, src, tgt, technique, CAST(round(posterior * 1e9) AS BIGINT) AS posterior_e9, k FROM adj")
def similar_edge_topk(spark, sf_dir):
    """The strongest transitions with the assets' similarity in the prior (their first embeddings)."""
    i = materialise(inv(spark, sf_dir, *SCORED, "sensitivity"), "inventory")
    vectors = em.initial(em.features(i)).select("id", F.slice("e", 1, em.FEATURES).alias("v"))  # zeros from there on
    e = edges.similar_adjacency(i, vectors)
    return e.select("profile", "src", "tgt", "technique", F.rint(F.col("posterior") * 1e9).cast("bigint").alias("posterior_e9"), "k")


@query(sql.with_(sql.INV, sql.REACH) + ", rep AS (SELECT zone, min(id) AS id FROM inv GROUP BY zone) SELECT a.id AS source, b.id AS target FROM rep a JOIN reach ON rs = a.zone JOIN rep b ON b.zone = rt WHERE rs <> rt")
def topology_edges(spark, sf_dir):
    return em.topology(inv(spark, sf_dir, "zone"))


def attention_embeddings(spark, sf_dir):
    """Two attention layers over zone representatives and members; norm and first entries of each embedding."""
    i = materialise(inv(spark, sf_dir, "type", "zone", "criticality", "internet_facing", "domain_joined", "findings", "sensitivity"), "inventory")
    e = em.attention(em.initial(em.features(i)).select("id", "e"), em.topology(i).unionByName(em.star(i)), width=em.FEATURES)
    return e.select("id", F.round(F.sqrt(em.dot(F.col("e"), F.col("e"))), 6).alias("norm"), *[F.round(F.get("e", F.lit(k)), 6).alias(f"e{k}") for k in (0, 5, 10, 20)])


QUERIES["attention_embeddings"] = attention_embeddings


@query("""SELECT query, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query, r.vec_id AS vec_id, round(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * r.v[i])) / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(r.v, lambda x: x * x))) + 1e-8), 6) AS sim
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0) q JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) r ON q.vec_id <> r.vec_id)) WHERE rank <= 10""")
def nearest_embeddings(spark, sf_dir):
    """A stated query set (every hundredth id) against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return em.nearest_of(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)
