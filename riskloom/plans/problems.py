"""Queries of the general problems 4 and 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.findings import BY_GROUP, fill_findings, masked_accuracy
from ..operators.records import SCALARS, child_links, entity_table
from ..session import table


def p4_found(spark, sf_dir):
    return child_links(table(spark, sf_dir, "analysis_records"))


def p6_found(spark, sf_dir):
    """The label is that of the value copied from the donors; the label wanted is the group's, so the group alone predicts."""
    cells = fill_findings(table(spark, sf_dir, "findings"), BY_GROUP, back_off=False)
    return cells.where("label IS NOT NULL").select("finding_id", F.col("field").alias("field_name"), F.col("label").alias("fill_label"))


def p6_filled(spark, sf_dir):
    """Every missing cell with its donors and the value copied from them, cvss and epss predicted from one another as well."""
    return fill_findings(table(spark, sf_dir, "findings"))


def p6_accuracy(spark, sf_dir):
    """Fills of hidden known cells against what was hidden."""
    return masked_accuracy(table(spark, sf_dir, "findings"))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p6_filled": p6_filled, "p6_accuracy": p6_accuracy}



def _entities(kind):
    def run(spark, sf_dir):
        return entity_table(table(spark, sf_dir, "analysis_records"), kind)

    run.__doc__ = f"The flat table of kind {kind!r} with its scalars, tied to its parents."
    return run


for _kind in SCALARS:
    QUERIES[f"p4_{_kind}_table"] = _entities(_kind)

_KNOWN = """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at DESC) AS rn FROM findings) WHERE rn = 1
), known AS (
  SELECT finding_id, misconfig_id, date_trunc('month', observed_at) AS m,
    CASE WHEN lower(trim(severity)) IN ('critical','high','medium','low') THEN lower(trim(severity)) END AS severity,
    CASE WHEN NOT isnan(cvss) AND cvss BETWEEN 0 AND 10 THEN cvss END AS cvss,
    CASE WHEN NOT isnan(epss) AND epss BETWEEN 0 AND 1 THEN epss END AS epss
  FROM latest
), votes AS (
  SELECT misconfig_id, m, severity, count(*) AS n,
    CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r
  FROM known WHERE severity IS NOT NULL GROUP BY ALL
), modes AS (
  SELECT misconfig_id, m, severity AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY misconfig_id, m ORDER BY n DESC, r DESC) AS rn FROM votes) WHERE rn = 1
), meds AS (
  SELECT misconfig_id, m, round(quantile_cont(cvss, 0.5), 9) AS c, round(quantile_cont(epss, 0.5), 9) AS e
  FROM known GROUP BY ALL
)
"""

ORACLE = {
    "p6_found": _KNOWN
    + """
SELECT finding_id, 'severity' AS field_name, label AS fill_label
FROM known k JOIN modes USING (misconfig_id, m) WHERE k.severity IS NULL
UNION ALL
SELECT finding_id, 'cvss', CASE WHEN c < 4 THEN 'low' WHEN c < 7 THEN 'medium' WHEN c < 9 THEN 'high' ELSE 'critical' END
FROM known k JOIN meds USING (misconfig_id, m) WHERE k.cvss IS NULL AND c IS NOT NULL
UNION ALL
SELECT finding_id, 'epss', CASE WHEN e < 0.1 THEN 'low' WHEN e < 0.5 THEN 'medium' ELSE 'high' END
FROM known k JOIN meds USING (misconfig_id, m) WHERE k.epss IS NULL AND e IS NOT NULL
"""
}
