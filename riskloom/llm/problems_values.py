"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.delivery import latest_delivery
from ..session import table
from .canonical import map_columns


def p3_found(spark, sf_dir):
    assets = latest_delivery(table(spark, sf_dir, "assets"), "id", "ingested_at", {"type": "type", "zone": "zone"})
    found = map_columns(assets, "id", ["type", "zone"], table(spark, sf_dir, "canon_ref"))
    return found.select(F.col("id").alias("asset_id"), "field_name", F.coalesce("canonical", F.lit("(none)")).alias("canonical"))


QUERIES = {"p3_found": p3_found}
ORACLE: dict[str, str] = {}
