"""Seeded inventories and scan results as fixtures: the same seed gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = (
    "id string, name string, type string, ip string, zone string, criticality int, internet_facing boolean, domain_joined boolean, services array<string>, data_sensitivity string, "
    "misconfigurations array<struct<id:string,title:string,description:string,category:string,severity:string,cvss:double,epss:double,exploit_available:boolean>>, ingested_at timestamp"
)


class Lcg:
    """A linear congruential sequence as double arithmetic gives it: the product is rounded before it is masked."""

    def __init__(self, seed: int):
        self.seed = seed

    def next(self) -> float:
        """The next number from 0 to below 1."""
        self.seed = int(float(self.seed) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        return self.seed / 0x7FFFFFFF

    def shuffled(self, rows: Sequence) -> list:
        """A permutation drawn from the end to the front."""
        out = list(rows)
        for i in range(len(out) - 1, 0, -1):
            j = math.floor(self.next() * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out


@dataclass(frozen=True)
class Template:
    """A kind of asset of a seeded inventory: how many, in which zones (shared out evenly), how exposed."""

    prefix: str
    type: str
    zones: tuple[str, ...]
    count: int
    criticality: int
    internet: float = 0.0  # share that faces the internet
    findings: tuple[int, int] = (0, 2)  # fewest and most
    sensitivity: str = "user_data"
    services: tuple[str, ...] = ()


#: A small enterprise; pass other templates for other shapes.
ENTERPRISE = (
    Template("WEB", "web_server", ("dmz", "prod-web"), 8, 3, 0.5, (1, 3), "business_logic", ("http",)),
    Template("APP", "app_server", ("prod-app",), 6, 3, 0.0, (1, 3), "business_logic", ("http", "ssh")),
    Template("DB", "database_server", ("prod-db", "restricted"), 5, 4, 0.0, (1, 2), "pii", ("sql",)),
    Template("DC", "domain_controller", ("restricted", "mgmt"), 3, 5, 0.0, (1, 2), "credentials", ("ldap", "kerberos")),
    Template("FS", "file_server", ("corp",), 4, 3, 0.0, (1, 3), "user_files", ("smb",)),
    Template("JMP", "jump_server", ("mgmt",), 2, 4, 0.5, (1, 2), "credentials", ("ssh", "rdp")),
    Template("WS", "workstation", ("corp", "corp-wifi", "dev-app"), 20, 1, 0.0, (0, 2), "user_data", ("rdp",)),
)


def seeded_inventory(spark: SparkSession, catalogue: Sequence[tuple[str, str, str, str]], templates: Sequence[Template] = ENTERPRISE, total: int = 50, seed: int = 42) -> DataFrame:
    """``total`` assets in ingest form: templates first, shared over their zones, then workstations to fill up.

    ``catalogue``: (id, title, category, severity) of the findings to draw from. Names count up per template, addresses
    are unique, the order is a seeded permutation. Built in the driver, for fixtures; ``scaled_inventory`` is for sizes.
    """
    rng, rows, number, taken = Lcg(seed), [], {}, set()
    wanted = [(t, z) for t in templates for k, z in enumerate(t.zones) for _ in range(-(-(t.count - k) // len(t.zones)))][:total]
    pad = Template("WS", "workstation", ("corp",), 1, 1)
    wanted += [(pad, "corp")] * (total - len(wanted))
    for t, zone in wanted:
        number[t.prefix] = number.get(t.prefix, 0) + 1
        while True:
            ip = f"10.{math.floor(rng.next() * 250)}.{math.floor(rng.next() * 250)}.{math.floor(rng.next() * 250) + 1}"
            if ip not in taken:
                taken.add(ip)
                break
        low, high = t.findings
        picked = rng.shuffled(catalogue)[: low + math.floor(rng.next() * (high - low + 1))]
        found = [(i, title, None, category, severity, None, None, rng.next() < 0.3) for i, title, category, severity in picked]
        name = f"{t.prefix}-{number[t.prefix]:03d}"
        rows.append((f"asset-{len(rows):05d}", name, t.type, ip, zone, t.criticality, rng.next() < t.internet, rng.next() < 0.8, list(t.services), t.sensitivity, found, None))
    return spark.createDataFrame(rng.shuffled(rows), SCHEMA)


def uniform(*parts: Column | int) -> Column:
    """A number from 0 to below 1 drawn from a hash: the same wherever and in whatever order rows are computed."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 40)) / float(1 << 40)


def permuted(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows in a seeded order, repeatable on any cluster; ties by the key."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


def scaled_inventory(spark: SparkSession, rows: int, templates: Sequence[Template] = ENTERPRISE, seed: int = 42) -> DataFrame:
    """``id, name, type, zone, criticality, internet_facing`` of any number of assets, drawn in the tasks by hash.

    Kinds come in proportion to their counts; names count up per template by a window over each template's rows, which
    are numbered in ranges of ids first.
    """
    total, kind = sum(t.count for t in templates), F.lit(len(templates) - 1)
    draw = uniform(F.col("id"), seed) * total
    for i, t in reversed(list(enumerate(templates))):
        start = sum(x.count for x in templates[:i])
        kind = F.when((draw >= start) & (draw < start + t.count), i).otherwise(kind)
    pick = lambda get: F.element_at(F.array(*[F.lit(get(t)) for t in templates]), F.col("kind") + 1)
    zones = F.element_at(F.array(*[F.array(*[F.lit(z) for z in t.zones]) for t in templates]), F.col("kind") + 1)
    rows_ = spark.range(rows).withColumn("kind", kind).withColumn("block", F.floor(F.col("id") / 100_000))
    sizes = rows_.groupBy("kind", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("kind", "block", (F.sum("n").over(Window.partitionBy("kind").orderBy("block")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("kind", "block").orderBy("id"))
    numbered = rows_.withColumn("at", at).join(before, ["kind", "block"])
    zone = F.element_at(zones, (F.floor(uniform(F.col("id"), seed + 1) * F.size(zones)) + 1).cast("int"))
    return numbered.select(
        F.concat(F.lit("asset-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("id"), F.concat(pick(lambda t: t.prefix), F.lit("-"), F.lpad((F.col("at") + F.col("before")).cast("string"), 6, "0")).alias("name"),
        pick(lambda t: t.type).alias("type"), zone.alias("zone"), pick(lambda t: t.criticality).alias("criticality"), (uniform(F.col("id"), seed + 2) < pick(lambda t: t.internet)).alias("internet_facing"),
    )


def scan_results(targets: DataFrame, key: str, catalogue: Sequence[str], seed: int = 7, success: float = 0.95, most: int = 4) -> DataFrame:
    """``key, success, findings``: a made-up scan of each target: most succeed, with 1 to ``most`` different findings.

    Findings are the first of the catalogue in an order drawn per target by hash. A failed scan has none.
    """
    n = F.floor(uniform(F.col(key), seed) * most).cast("int") + 1
    order = F.array_sort(F.transform(F.array(*[F.lit(c) for c in catalogue]), lambda c: F.struct(F.xxhash64(F.col(key), c, F.lit(seed)).alias("h"), c.alias("c"))))
    ok = uniform(F.col(key), seed + 1) < success
    return targets.select(key, ok.alias("success"), F.when(ok, F.transform(F.slice(order, F.lit(1), n), lambda x: x["c"])).otherwise(F.array().cast("array<string>")).alias("findings"))


def command_catalogue(spark: SparkSession, groups: dict[str, Sequence[str]], platform: str) -> DataFrame:
    """``platform, group, position, command``: a collector's commands as a table; running them isn't part of this engine."""
    rows = [(platform, g, i, c) for g, cs in groups.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "platform string, `group` string, position int, command string")


def batched(commands: DataFrame, marker: str = "###GROUP:") -> DataFrame:
    """``platform, script``: one text per platform that prints each group's marker and runs its commands in order."""
    per = commands.groupBy("platform", "group").agg(F.array_sort(F.collect_list(F.struct("position", "command"))).alias("cs"), F.min("position").alias("first"))
    text = F.concat_ws("\n", F.concat(F.lit(f"echo '{marker} "), F.col("group"), F.lit("'")), F.concat_ws("\n", F.transform("cs", lambda c: F.concat(c["command"], F.lit(" || echo CMD_FAILED")))))
    return per.select("platform", "group", text.alias("t")).groupBy("platform").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "t"))), lambda x: x["t"]), "\n").alias("script"))


def from_jdbc(spark: SparkSession, url: str, dbtable: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of a numeric ``column`` where one is named."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()
