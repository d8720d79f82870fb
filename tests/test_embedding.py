"""Attention over links against brute force, and what it may broadcast."""

import math
import random
import re

from pyspark.sql import functions as F

from riskloom.operators import embedding as em


def brute(vectors, edges, layers=2):
    size = em.DIM // em.HEADS
    near = {i: [] for i in vectors}
    for s, t in edges:
        near[s].append(t)
        near[t].append(s)
    for _ in range(layers):
        new = {}
        for i, v in vectors.items():
            mix = []
            for h in range(em.HEADS):
                part = lambda x: x[h * size : (h + 1) * size]  # noqa: B023, E731
                dots = [sum(a * b for a, b in zip(part(v), part(vectors[t]))) for t in near[i]]
                w = [math.exp(d - max(dots)) for d in dots]
                mix += [sum(x * part(vectors[t])[k] for x, t in zip(w, near[i])) / sum(w) if w else None for k in range(size)]
            new[i] = [a if b is None else 0.7 * a + 0.3 * b for a, b in zip(v, mix)]
        vectors = new
    return vectors


#: A star, two linked hubs with a doubled edge, a triangle, a pair, a node without links.
EDGES = [("h1", f"m{k}") for k in range(6)] + [(f"n{k}", "h2") for k in range(3)] + [("h1", "h2"), ("h2", "h1")] + [("t1", "t2"), ("t2", "t3"), ("t3", "t1"), ("t1", "h1"), ("p1", "p2")]
IDS = sorted({x for e in EDGES for x in e} | {"alone"})


def check(spark, scale, width=em.DIM):
    r = random.Random(5)
    vectors = {i: [r.uniform(-scale, scale) if k < width else 0.0 for k in range(em.DIM)] for i in IDS}
    emb = spark.createDataFrame(list(vectors.items()), "id string, e array<double>")
    edges = spark.createDataFrame(EDGES, "source string, target string")
    got = {x.id: x.e for x in em.attention(emb, edges, width=width).collect()}
    want = brute(vectors, EDGES)
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for i in IDS for a, b in zip(got[i], want[i], strict=True))


def test_attention_against_brute_force(spark):
    check(spark, 12.0, em.FEATURES)  # scores of hundreds, in several bands


def test_many_vectors_are_not_broadcast(spark, monkeypatch):
    """Zeros compress to nothing: by the size of its files a table of 30 MB of vectors looked small enough to broadcast."""
    plans = []
    write = em.materialise
    monkeypatch.setattr(em, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    emb = write(spark.range(30_000).select(F.concat(F.lit("a"), "id").alias("id"), F.array_repeat(F.lit(0.0), em.DIM).alias("e")), "test-vectors")
    ring = spark.range(30_000).select(F.concat(F.lit("a"), "id").alias("source"), F.concat(F.lit("a"), ((F.col("id") + 1) % 30_000)).alias("target"))
    monkeypatch.setattr(em, "SENT", 1_000_000, raising=False)
    em.attention(emb, ring, layers=1, width=em.FEATURES)
    wide = [p for p in plans if re.search(r"\be#", p)]
    assert wide and not any("BroadcastHashJoin" in p for p in wide)
