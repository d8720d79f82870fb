"""Assets, findings, evidence, paths, nodes and edges out of raw analysis records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .delivery import latest_delivery
from .shred import shred_objects

KEYS = ("id", "path_id", "asset_id", "source_id", "target_id", "source")
#: The other scalars of each kind of entity, with their types, and the lists of scalars.
SCALARS = {
    "asset": {"name": "string", "type": "string", "zone": "string", "criticality": "int", "internet_facing": "boolean", "domain_joined": "boolean", "data_sensitivity": "string"},
    "finding": {"title": "string", "category": "string", "severity": "string", "cvss": "double", "epss": "double", "exploit_available": "boolean"},
    "evidence": {"confidence": "double", "last_updated": "bigint"},
    "path": {"profile": "string", "path_probability": "double", "realism_score": "double", "impact_score": "double"},
    "node": {"misconfig_id": "string", "criticality": "int"},
    "edge": {"source_id": "string", "target_id": "string", "technique": "string", "probability": "double"},
    "reference": {"kind": "string", "ref": "string"},
}
LISTS = {"asset": {"services": "string"}, "path": {"kill_chain": "string"}, "node": {"services": "string"}, "edge": {"confidence_interval": "double"}}


def _as(type_: str):
    return lambda x: x.try_cast(type_)


def _snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))


def record_objects(records: DataFrame, fields=(), lists=()) -> DataFrame:
    """The objects of all records, one row each, with the scalars that name them and ``fields`` and ``lists`` of others."""
    latest = latest_delivery(records, "record_id", "received_at", {"payload": "payload"})
    names = [*KEYS, *[f for f in fields if f not in KEYS]]
    found = shred_objects(latest, "record_id", "payload", names, lists).withColumn("flat", F.regexp_replace("label", "_", ""))
    return materialise(found, "objects")  # read several times below; each text is parsed once


def children(e: DataFrame, carry=()) -> DataFrame:
    """``record_id, child_kind, parent_key, pos, child_key, node, *carry`` of every child in ``record_objects``.

    Wrappers of any depth are passed through; an object of the outermost level counts as a path if it has a path id,
    else as an asset if it has an id. Evidence comes as objects under their source's name or as a list naming its
    source; its place is 0. Children (or parents) without a key don't come out. ``node`` is the object's number.
    """
    bare = F.col("parent").isNull()
    kind = (
        F.when((F.col("flat") == "attackpaths") | (bare & F.col("path_id").isNotNull()), "path")
        .when((F.col("flat") == "assets") | (bare & F.col("id").isNotNull()), "asset")
        .when(F.col("flat") == "misconfigurations", "finding")
        .when(F.col("flat") == "nodes", "node")
        .when(F.col("flat") == "edges", "edge")
        .when(F.col("flat") == "evidence", "evidence")
    )
    e = e.withColumn("child_kind", kind)
    tops = e.where("child_kind IN ('asset', 'path')").select(
        F.col("doc").alias("record_id"), "child_kind", F.col("doc").cast("string").alias("parent_key"), F.col("ordinal").alias("pos"),
        F.when(F.col("child_kind") == "path", F.col("path_id")).otherwise(F.col("id")).alias("child_key"), "node", *carry,
    )
    below = e.where("child_kind IS NULL OR child_kind NOT IN ('asset', 'path')").withColumnRenamed("child_kind", "below_kind")
    owner = tops.select(F.col("record_id").alias("doc"), F.col("node").alias("parent"), F.col("child_kind").alias("owner"), F.col("child_key").alias("parent_key"))
    first = below.where("below_kind IS NOT NULL").join(owner, ["doc", "parent"])
    # an evidence object without a source of its own holds one object per source
    holder = first.where("below_kind = 'evidence' AND owner = 'asset' AND source IS NULL").select("doc", F.col("node").alias("parent"), "parent_key")
    named = below.where("below_kind IS NULL").join(holder, ["doc", "parent"]).select(
        F.col("doc").alias("record_id"), F.lit("evidence").alias("child_kind"), "parent_key", F.lit(0).alias("pos"), F.col("label").alias("child_key"), "node", *carry
    )
    key = (
        F.when((F.col("below_kind") == "finding") & (F.col("owner") == "asset"), F.upper(F.trim("id")))
        .when((F.col("below_kind") == "evidence") & (F.col("owner") == "asset"), _snake(F.col("source")))
        .when((F.col("below_kind") == "node") & (F.col("owner") == "path"), F.col("asset_id"))
        .when((F.col("below_kind") == "edge") & (F.col("owner") == "path"), F.concat("source_id", F.lit(">"), "target_id"))
    )
    direct = first.select(
        F.col("doc").alias("record_id"), F.col("below_kind").alias("child_kind"), "parent_key",
        F.when(F.col("below_kind") == "evidence", 0).otherwise(F.col("ordinal")).alias("pos"), key.alias("child_key"), "node", *carry,
    )
    out = tops.unionByName(direct).unionByName(named)
    return out.where("child_key IS NOT NULL AND parent_key IS NOT NULL")


def child_links(records: DataFrame) -> DataFrame:
    """``record_id, child_kind, parent_key, pos, child_key`` of every child with a key, distinct; see ``children``.

    A record delivered twice counts once, by its latest delivery. Nothing comes from null or invalid payloads or
    from null entries.
    """
    return children(record_objects(records)).select("record_id", "child_kind", "parent_key", "pos", "child_key").distinct()


def entity_table(records: DataFrame, kind: str) -> DataFrame:
    """One flat table of a ``kind``: record_id, parent_key, pos, child_key and its own scalars and lists, typed.

    Kinds: asset, finding, evidence, path, node, edge, and reference (parent: the finding's id; its key is ``ref``).
    Parents are tied by key as in ``child_links``, one row per object delivered. A scalar that doesn't fit its type is
    null, a missing or null list too. Only the kind's own scalars are read out of the payloads.
    """
    scalars, lists = SCALARS[kind], LISTS.get(kind, {})
    e = record_objects(records, scalars, lists)
    typed = [F.col(f).try_cast(t).alias(f) for f, t in scalars.items()] + [F.transform(f, _as(t)).alias(f) for f, t in lists.items()]
    if kind != "reference":
        found = children(e, [*scalars, *lists])
        return found.where(F.col("child_kind") == kind).select("record_id", "parent_key", "pos", "child_key", *typed)
    finding = children(e).where("child_kind = 'finding'").select(F.col("record_id").alias("doc"), F.col("node").alias("parent"), F.col("child_key").alias("parent_key"))
    found = e.where("flat = 'references' AND ref IS NOT NULL").join(finding, ["doc", "parent"])
    return found.select(F.col("doc").alias("record_id"), "parent_key", F.col("ordinal").alias("pos"), F.col("ref").alias("child_key"), *typed)
