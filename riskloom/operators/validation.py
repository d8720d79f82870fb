"""Confidence of detections: context, rules, known false positives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: known false-positive patterns, and files that are set-user-id by design ---------------------
KNOWN = {
    "VM004": ["nobody", "systemd-network", "systemd-resolve"],
    "VM016": ["/usr/bin/passwd", "/usr/bin/sudo", "/usr/bin/su", "/usr/bin/ping", "/usr/bin/newgrp"],
    "VM010": ["/tmp", "/var/tmp"],
    "VM019": ["docker", "container", "lxc"],
}
SAFE_SUID = "/usr/bin/passwd /usr/bin/sudo /usr/bin/su /usr/bin/ping /usr/bin/ping6 /usr/bin/newgrp /usr/bin/chsh /usr/bin/chfn /usr/bin/gpasswd /usr/bin/at /usr/bin/crontab".split()
TEMP = ["/tmp", "/var/tmp", "/dev/shm"]


def raw(key: str) -> Column:
    return F.coalesce(F.try_element_at("raw", F.lit(key)), F.lit(""))


def has(key: str, *texts: str) -> Column:
    out = F.lit(False)
    for t in texts:
        out = out | F.contains(raw(key), F.lit(t))
    return out


def parse_list(c: Column) -> Column:
    """The entries of a list on lines or with commas, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"[\n,]"), lambda s: F.trim(s)), lambda s: s != "")


def ports(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r":([0-9]+)"), 1), lambda p: p.cast("int")))


def context(df: DataFrame) -> DataFrame:
    """What a host's raw results (map ``raw``) say about it. 'inactive' is not 'active' here."""
    active = lambda k: F.lower(raw(k)).rlike(r"\bactive\b")
    return df.withColumns(
        {
            "is_container": has("hostname", "docker", "container") | has("interfaces", "docker", "veth", "cni"),
            "is_vm": has("interfaces", "vnet", "ens") | has("dmi", "VMware", "VirtualBox", "QEMU"),
            "is_hardened": has("sshd_config", "SELINUX=enforcing", "apparmor") | has("kernel", "grsec"),
            "firewall_active": active("firewall_ufw") | active("firewalld_status") | has("iptables_rules", "DROP"),
            "services": parse_list(raw("services")), "ports": ports(raw("listening")),
        }
    )


def _none_of(key: str, texts: list[str]) -> Column:
    """The lines of a raw result that hold none of the texts."""
    def clean(f):
        out = F.lit(True)
        for t in texts:
            out = out & ~F.contains(f, F.lit(t))
        return out

    return F.filter(F.split(raw(key), "\n"), clean)


@dataclass
class Rules:
    """Confidence rules by misconfiguration, (condition, change) in order; both tables can be extended."""

    rules: dict[str, list[tuple[Callable[[], Column], float]]] = field(default_factory=dict)
    known: dict[str, list[str]] = field(default_factory=dict)

    def add(self, misconfig: str, condition: Callable[[], Column], change: float) -> None:
        self.rules.setdefault(misconfig, []).append((condition, change))

    def mark_false_positive(self, misconfig: str, text: str) -> None:
        self.known.setdefault(misconfig, []).append(text.lower())


def default_rules() -> Rules:
    r = Rules(known={k: list(v) for k, v in KNOWN.items()})
    r.add("VM004", lambda: has("shadow", "!", "*"), -0.4)
    r.add("VM004", lambda: has("passwd", "/sbin/nologin", "/bin/false"), -0.3)
    r.add("VM008", lambda: has("sshd_config", "PermitRootLogin prohibit-password", "PermitRootLogin without-password"), -0.3)
    r.add("VM008", lambda: has("sshd_config", "PasswordAuthentication no"), -0.2)
    r.add("VM010", lambda: has("world_writable", "t"), -0.2)
    r.add("VM010", lambda: F.size(_none_of("world_writable", TEMP)) < F.size(F.split(raw("world_writable"), "\n")) * 0.3, -0.4)
    r.add("VM016", lambda: F.size(_none_of("suid_sgid", SAFE_SUID)) == 0, -0.5)
    r.add("VM016", lambda: F.size(_none_of("suid_sgid", SAFE_SUID)) > 0, 0.2)
    r.add("VM019", lambda: F.col("is_container"), -0.5)
    r.add("VM019", lambda: F.col("zone") == "cloud", -0.2)
    r.add("VM007", lambda: F.col("is_vm") & has("hostname", "template"), -0.3)
    return r


def validate(detections: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Adds ``confidence, risk, validated``; needs misconfig_id, detected, evidence, os, zone, raw (a map).

    Starts at 0.5 if detected, else 1; each rule of the misconfiguration that holds changes it; a known
    false-positive pattern in 'os:zone:evidence' takes 0.3; the result is kept within 0..1. One projection.
    """
    rules = rules or default_rules()
    df = context(detections)
    conf = F.when(F.col("detected"), 0.5).otherwise(1.0)
    for mid, rs in rules.rules.items():
        for cond, change in rs:
            conf = conf + F.when((F.col("misconfig_id") == mid) & cond(), change).otherwise(0.0)
    seen = F.lower(F.concat_ws(":", F.coalesce("os", F.lit("")), F.coalesce("zone", F.lit("")), F.coalesce("evidence", F.lit(""))))
    for mid, texts in rules.known.items():
        hit = F.lit(False)
        for t in texts:
            hit = hit | F.contains(seen, F.lit(t))
        conf = conf - F.when((F.col("misconfig_id") == mid) & hit, 0.3).otherwise(0.0)
    c = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 9)
    return df.withColumn("confidence", c).withColumn("risk", F.when(F.col("confidence") < 0.3, "high").when(F.col("confidence") < 0.6, "medium").otherwise("low")).withColumn("validated", F.col("confidence") >= 0.5)


def statistics(validated: DataFrame) -> DataFrame:
    """Counts by confidence and the estimated share of false positives (0 without detections)."""
    c = F.col("confidence")
    s = validated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c >= 0.8).alias("high_confidence"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium_confidence"),
        F.count_if(c < 0.5).alias("low_confidence"), F.count_if(~F.col("validated")).alias("suppressed"),
    )
    return s.withColumn("fp_rate", F.coalesce(F.round(F.try_divide("low_confidence", F.col("total")), 6), F.lit(0.0)))


def kept_and_suppressed(validated: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds ``kept`` and ``reason``: why a detection is suppressed, null where it is kept."""
    low = F.col("confidence") < least
    return validated.withColumns({"kept": ~low, "reason": F.when(low, F.format_string("confidence %.2f is below %.2f (risk of a false positive: %s)", F.col("confidence"), F.lit(least), F.col("risk")))})
