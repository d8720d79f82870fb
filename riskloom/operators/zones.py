"""Network zones of assets from addresses, VLANs, host names, services and cloud providers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def ip_number(c: Column) -> Column:
    """An IPv4 address as a number; null unless it is four parts of 0..255."""
    parts = F.transform(F.split(F.trim(c), r"\."), lambda p: F.when(p.rlike(r"^\d{1,3}$"), F.try_to_number(p, F.lit("999")).cast("bigint")))
    fine = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.between(0, 255), F.lit(False)))
    return F.when(fine, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p))


def _first(rules: list[tuple[Column, str, float]]) -> Column:
    """(zone, confidence) of the first rule that holds, null if none does."""
    out = None
    for hit, zone, conf in rules:
        r = F.struct(F.lit(zone).alias("zone"), F.lit(conf).alias("confidence"))
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return out


@dataclass
class ZoneRules:
    """Ordered rules of each kind, (pattern, zone, confidence), and VLAN numbers by zone; all can be extended."""

    cidr: list[tuple[str, str, float]] = field(default_factory=lambda: [r[1:] for r in fixed.zone_rules("cidr")])
    hostname: list[tuple[str, str, float]] = field(default_factory=lambda: [r[1:] for r in fixed.zone_rules("hostname")])
    service: list[tuple[str, str, float]] = field(default_factory=lambda: [r[1:] for r in fixed.zone_rules("service")])
    cloud: list[tuple[str, str, float]] = field(default_factory=lambda: [r[1:] for r in fixed.zone_rules("cloud")])
    vlans: list[tuple[str, list[int]]] = field(default_factory=lambda: [(z, list(map(int, ids))) for z, ids in fixed.groups(fixed.VLANS)])

    def add(self, kind: str, pattern: str, zone: str, confidence: float, first: bool = False) -> None:
        """A rule of kind 'cidr', 'hostname', 'service' or 'cloud', behind the others or before them."""
        rules = getattr(self, kind)
        rules.insert(0 if first else len(rules), (pattern, zone, confidence))

    def add_zone(self, zone: str, blocks: tuple[str, ...] = (), vlans: tuple[int, ...] = (), confidence: float = 0.9) -> None:
        """A zone with its address blocks and VLANs."""
        self.cidr += [(b, zone, confidence) for b in blocks]
        if vlans:
            self.vlans.append((zone, list(vlans)))


DEFAULT = ZoneRules()


def by_cidr(ip: Column, rules: ZoneRules = DEFAULT) -> Column:
    """Range test against the ordered blocks: the list is short and fixed, so it is code, not a join."""
    n = ip_number(ip)
    return _first([(n.between(*fixed.cidr_range(p)), z, c) for p, z, c in rules.cidr])


def by_vlan(vlan: Column, rules: ZoneRules = DEFAULT) -> Column:
    return _first([(vlan.isin(*ids), z, fixed.VLAN_CONFIDENCE) for z, ids in rules.vlans])


def by_hostname(name: Column, rules: ZoneRules = DEFAULT) -> Column:
    return _first([(name.rlike(f"(?i){p}"), z, c) for p, z, c in rules.hostname])


def by_cloud(provider: Column, rules: ZoneRules = DEFAULT) -> Column:
    return _first([(F.contains(F.lower(provider), F.lit(p)), z, c) for p, z, c in rules.cloud])


def by_services(services: Column, rules: ZoneRules = DEFAULT) -> Column:
    """The zone most matches speak for: matches x summed confidence, its mean confidence; row-local."""
    zones = list(dict.fromkeys(z for _, z, _ in rules.service))
    votes = []
    for at, zone in enumerate(zones):
        n, total = F.lit(0), F.lit(0.0)
        for p, z, c in rules.service:
            if z == zone:
                k = F.size(F.filter(services, _holds(p)))
                n, total = n + k, total + k * c
        votes.append(F.when(n > 0, F.struct((n * total).alias("score"), F.lit(-at).alias("turn"), F.lit(zone).alias("zone"), F.round(total / n, 9).alias("confidence"))))
    best = F.array_max(F.array(*votes))
    return F.when(best.isNotNull(), F.struct(best["zone"].alias("zone"), best["confidence"].alias("confidence")))


def _holds(pattern: str):
    return lambda s: F.contains(F.lower(s), F.lit(pattern))


def detect(hosts: DataFrame, key: str, ip: str, hostname: str, services: str, vlan: str | None = None, provider: str | None = None, rules: ZoneRules = DEFAULT) -> DataFrame:
    """``key, zone, confidence, evidences``: all evidence combined.

    Each kind of evidence names a zone with a confidence; the zone with the largest sum wins (the earlier kind on
    ties), its confidence is that sum over the number of evidences, at most 1. No evidence: 'unknown', 0. All
    rules are code inside one projection: no join, no shuffle.
    """
    none = F.lit(None).cast("struct<zone:string,confidence:double>")
    found = F.array_compact(F.array(
        by_cidr(F.col(ip), rules), by_vlan(F.col(vlan), rules) if vlan else none, by_hostname(F.col(hostname), rules), by_services(F.col(services), rules), by_cloud(F.col(provider), rules) if provider else none
    ))
    sums = F.transform("__e", lambda e, i: F.struct(
        F.round(F.aggregate(F.filter("__e", lambda x: x["zone"] == e["zone"]), F.lit(0.0), lambda a, x: a + x["confidence"]), 9).alias("total"), (-i).alias("turn"), e["zone"].alias("zone")
    ))
    out = hosts.select(key, found.alias("__e")).select(key, F.array_max(sums).alias("b"), F.size("__e").alias("evidences"))
    return out.select(key, F.coalesce("b.zone", F.lit("unknown")).alias("zone"), F.when(F.col("evidences") > 0, F.least(F.lit(1.0), F.col("b.total") / F.col("evidences"))).otherwise(0.0).alias("confidence"), "evidences")


def by_prefix(ip: Column) -> Column:
    """The short rule: zone by the address's first characters."""
    starts = lambda *ps: F.coalesce(ip.rlike("^(" + "|".join(p.replace(".", r"\.") for p in ps) + ")"), F.lit(False))
    return F.when(starts("192.168.0.", "10.0.0."), "dmz").when(starts("10.1.", "10.2.", "172.20."), "internal").when(starts("10.10.", "10.100."), "restricted").otherwise("internal")
