"""The inventory in its normal form: one row per asset, one row per finding, and what is counted over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import switch, tiers
from .delivery import latest_delivery

SOURCES = ("vulnerability_scanner", "siem_alerts", "threat_intelligence", "historical_attacks", "network_flow")
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

FINDING = "array<struct<pos:int,finding_id:string,title:string,category:string,severity:string,cvss:double,epss:double,exploit_available:boolean>>"


def _findings(c: Column) -> Column:
    """A finding list in its normal form: ids trimmed and upper-cased, each id once (its first place), defaults set."""
    ids = F.transform(c, lambda m: F.upper(F.trim(m["id"])))
    placed = F.transform(
        c,
        lambda m, i: F.struct(
            i.alias("pos"), F.upper(F.trim(m["id"])).alias("finding_id"), m["title"].alias("title"), F.lower(m["category"]).alias("category"),
            F.lower(F.coalesce(m["severity"], F.lit("high"))).alias("severity"), m["cvss"].alias("cvss"), m["epss"].alias("epss"),
            F.coalesce(m["exploit_available"], F.lit(False)).alias("exploit_available"),
        ),
    )
    once = F.filter(placed, lambda f: F.array_position(ids, f["finding_id"]) == f["pos"] + 1)
    return F.coalesce(once, F.array().cast(FINDING))


def name_key(c: Column) -> Column:
    """A typed name in its comparable form: its words in lower case and in order of the alphabet, whatever stands between them."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(words), "-")


def reference_names(ref: DataFrame) -> DataFrame:
    """``field_name, key, canonical``: every way the reference list writes an entry; a way two entries share is none."""
    ways = F.concat(F.array("canonical", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = ref.select("field_name", "canonical", F.explode(ways).alias("way")).select("field_name", "canonical", name_key(F.col("way")).alias("key")).where("key <> ''")
    return rows.groupBy("field_name", "key").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("other")).where("canonical = other").drop("other")


def inventory(assets: DataFrame, ref: DataFrame | None = None, need: Sequence[str] = ()) -> DataFrame:
    """One row per asset id (latest delivery), defaults for what is missing, findings as a normalised list.

    Missing criticality is 0, missing flags are false, missing or blank zone and type 'unknown', missing sensitivity
    'user_data', missing evidence confidence 0. With ``ref`` (the reference list of names) a typed zone or type that
    is an entry's name, display name or alias but for case, punctuation and the order of words counts as the entry; others stay as
    typed (``unmapped_names`` lists them). ``need`` names the columns wanted besides ``id``, all by default: only they
    are read and shuffled, once, by the asset id. The reference list's names are joined after that; Spark broadcasts
    them while they are small.
    """
    no = F.lit(False)
    evidence = lambda s: F.coalesce(F.col(f"evidence.{s}.confidence"), F.lit(0.0))
    known = lambda s: F.when(evidence(s) > 0, 1).otherwise(0)
    typed = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    columns = {
        "name": F.col("name"), "ip": F.col("ip"), "type": typed(F.col("type")), "zone": typed(F.col("zone")),
        "criticality": F.coalesce("criticality", F.lit(0)), "internet_facing": F.coalesce("internet_facing", no),
        "domain_joined": F.coalesce("domain_joined", no), "services": F.coalesce("services", F.array().cast("array<string>")),
        "sensitivity": F.coalesce("data_sensitivity", F.lit("user_data")), "findings": _findings(F.col("misconfigurations")),
        "siem": evidence("siem_alerts"), "intel": evidence("threat_intelligence"), "sources": sum((known(s) for s in SOURCES[1:]), known(SOURCES[0])),
        "business_unit": F.col("business_unit"), "revenue": F.col("annual_revenue_exposure"),
    }
    if need:
        columns = {c: x for c, x in columns.items() if c in need}
    latest = latest_delivery(assets, "id", "ingested_at", columns)
    for c in ("zone", "type"):
        if ref is not None and c in columns:
            names = reference_names(ref).where(F.col("field_name") == c).select(F.col("key").alias("__k"), F.col("canonical").alias("__c"))
            latest = latest.join(names, name_key(F.col(c)) == F.col("__k"), "left").withColumn(c, F.coalesce("__c", c)).drop("__k", "__c")
    return latest


def unmapped_names(assets: DataFrame, ref: DataFrame) -> DataFrame:
    """``field_name, value, n``: the typed zones and types that name no entry of the reference list, with their assets."""
    latest = latest_delivery(assets, "id", "ingested_at", {"zone": "zone", "type": "type"})
    parts = [F.struct(F.lit(c).alias("field_name"), F.coalesce(F.trim(c), F.lit("")).alias("value")) for c in ("zone", "type")]
    values = latest.select(F.explode(F.array(*parts)).alias("p")).select("p.*").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    names = reference_names(ref).select("field_name", F.col("key").alias("__k"))
    return values.withColumn("__k", name_key(F.col("value"))).join(names, ["field_name", "__k"], "left_anti").select("field_name", "value", "n")


def findings_of(inv: DataFrame) -> DataFrame:
    """``asset_id, pos, finding_id, ...``: one row per asset and finding; no shuffle."""
    return inv.select(F.col("id").alias("asset_id"), F.explode("findings").alias("f")).select("asset_id", "f.*")


def severity_rank(c: Column) -> Column:
    return switch(c, SEVERITY_RANK, 0)


def top_finding(inv: DataFrame) -> DataFrame:
    """The finding of highest severity of each asset (the earlier in the list on ties), as struct ``top``.

    Row-local: the list is in the row, so no shuffle and no window. Assets without findings have a null.
    """
    best = F.array_max(F.transform("findings", lambda f: F.struct(severity_rank(f["severity"]).alias("r"), (-f["pos"]).alias("p"), f.alias("f"))))
    return inv.withColumn("top", best["f"])


def n_findings(test=None) -> Column:
    """How many findings of the row's list pass ``test``."""
    return F.size("findings") if test is None else F.size(F.filter("findings", test))


def of_severity(name: str):
    return lambda f: f["severity"] == name


def tier(c: Column) -> Column:
    return switch(F.lower(c), tiers(), 2)


def capped_sample(inv: DataFrame, exposed: int = 15, critical: int = 25, total: int = 80) -> DataFrame:
    """A capped, stratified choice: exposed assets first, then critical ones, then fill up; a feature, not a limit.

    The order within a stratum is by id (or give the input a shuffled id). Each stratum is a top-k, the rest an
    anti-join against at most ``exposed + critical`` ids.
    """
    a = inv.where("internet_facing").orderBy("id").limit(exposed).withColumn("stratum", F.lit("exposed"))
    b = inv.where("NOT internet_facing AND criticality >= 4").orderBy("id").limit(critical).withColumn("stratum", F.lit("critical"))
    taken = a.unionByName(b)
    rest = inv.join(taken.select("id"), "id", "left_anti").orderBy("id").limit(total).withColumn("stratum", F.lit("rest"))
    order = F.when(F.col("stratum") == "exposed", 0).when(F.col("stratum") == "critical", 1).otherwise(2)
    return taken.unionByName(rest).orderBy(order, "id").limit(total)
