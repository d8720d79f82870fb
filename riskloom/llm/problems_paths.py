"""Queries of problems 1, 2 and 5: patterns, pairs and ranks over assets and attack paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.delivery import latest_delivery
from ..session import materialise, table
from .cooccurrence import item_pairs
from .subsequences import frequent_subsequences
from .topn import top_n


def finding_id(c):
    return F.upper(F.trim(c))


def _step(c):
    return F.lower(F.trim(F.translate(c, "_", " ")))


P1 = {"kill_chain": 0.44, "nodes": 0.03}


def p1_found(spark, sf_dir):
    paths = latest_delivery(
        table(spark, sf_dir, "attack_paths"), "path_id", "ingested_at",
        {"kill_chain": F.transform("kill_chain", _step), "nodes": F.transform("nodes", lambda x: finding_id(x["misconfig_id"]))},
    )
    paths = materialise(paths.select("kill_chain", "nodes"), "sequences")
    out = None
    for kind, share in P1.items():
        found = frequent_subsequences(paths, kind, share, floor=5, min_len=3, max_len=4)
        rows = found.select(F.lit(kind).alias("seq_kind"), F.array_join("pattern", ">").alias("pattern"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p2_found(spark, sf_dir):
    ids = F.transform("misconfigurations", lambda x: finding_id(x["id"]))
    assets = latest_delivery(table(spark, sf_dir, "assets"), "id", "ingested_at", {"items": ids})
    pairs = item_pairs(assets, "id", "items", share=0.008, floor=5)
    big = lambda c: F.col(c).cast("decimal(18,0)")  # noqa: E731 - a product of two counts is beyond bigint from 3 billion records on
    return pairs.where(big("n_ab") * big("n") >= 2 * (big("n_a") * big("n_b"))).select(F.col("a").alias("misconfig_a"), F.col("b").alias("misconfig_b"))


def p5_found(spark, sf_dir):
    paths = latest_delivery(
        table(spark, sf_dir, "attack_paths"), "path_id", "ingested_at", {"pattern_signature": "pattern_signature", "final_risk_score": "final_risk_score"}
    )
    named = paths.where(~F.startswith(F.col("pattern_signature"), F.lit("__pending__")))
    return top_n(named, "pattern_signature", "final_risk_score", "path_id", 3).select("pattern_signature", "path_id", F.col("rank").alias("rank_in_group"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found}

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) AS rn FROM {table}) WHERE rn = 1)"
_PATHS = _LATEST.format(key="path_id", table="attack_paths")
_ASSETS = _LATEST.format(key="id", table="assets")


def _patterns(kind: str, steps: str, share: float) -> str:
    """Distinct step lists per path, by joins on growing places; only frequent steps can be in a pattern."""
    least = f"greatest(5, ceil({int(share * 100)} * (SELECT count(*) FROM {_PATHS}) / 100.0))"
    return f"""
SELECT '{kind}' AS seq_kind, pattern FROM (
  WITH s AS (SELECT path_id, generate_subscripts(st, 1) AS at, unnest(st) AS step FROM (SELECT path_id, {steps} AS st FROM {_PATHS})),
  f AS (SELECT * FROM s WHERE step IN (SELECT step FROM s GROUP BY step HAVING count(DISTINCT path_id) >= {least})),
  t AS (SELECT a.path_id, a.step AS s1, b.step AS s2, c.step AS s3, c.at FROM f a JOIN f b ON a.path_id = b.path_id AND a.at < b.at AND a.step <> b.step
        JOIN f c ON b.path_id = c.path_id AND b.at < c.at AND c.step NOT IN (a.step, b.step)),
  q AS (SELECT path_id, s1 || '>' || s2 || '>' || s3 AS pattern FROM t
        UNION ALL SELECT t.path_id, s1 || '>' || s2 || '>' || s3 || '>' || d.step FROM t JOIN f d ON t.path_id = d.path_id AND t.at < d.at AND d.step NOT IN (s1, s2, s3))
  SELECT pattern FROM q GROUP BY pattern HAVING count(DISTINCT path_id) >= {least})
"""


ORACLE = {
    "p1_found": _patterns("kill_chain", "list_transform(kill_chain, lambda x: lower(trim(replace(x, '_', ' '))))", 0.44)
    + " UNION ALL "
    + _patterns("nodes", "list_transform(nodes, lambda x: upper(trim(x.misconfig_id)))", 0.03),
    "p2_found": f"""
WITH a AS (SELECT * FROM {_ASSETS}), n AS (SELECT count(*) AS n FROM a),
i AS (SELECT DISTINCT id, upper(trim(m.id)) AS item FROM (SELECT id, unnest(misconfigurations) AS m FROM a) WHERE m.id IS NOT NULL),
c AS (SELECT item, count(*) AS n_i FROM i GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS n_ab FROM i x JOIN i y ON x.id = y.id AND x.item < y.item GROUP BY ALL)
SELECT a AS misconfig_a, b AS misconfig_b FROM p JOIN c ca ON a = ca.item JOIN c cb ON b = cb.item, n
WHERE n_ab >= 5 AND n_ab * 1000 >= 8 * n AND n_ab * n >= 2 * ca.n_i * cb.n_i
""",
    "p5_found": f"""
SELECT pattern_signature, path_id, CAST(r AS INTEGER) AS rank_in_group FROM (
  SELECT pattern_signature, path_id, row_number() OVER (PARTITION BY pattern_signature ORDER BY final_risk_score DESC, path_id) AS r
  FROM {_PATHS} WHERE pattern_signature IS NOT NULL AND NOT starts_with(pattern_signature, '__pending__')
    AND final_risk_score IS NOT NULL AND NOT isnan(final_risk_score)) WHERE r <= 3
""",
}
