"""Feature vectors, attention over the topology and cosine similarity of assets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..session import materialise

DIM, HEADS = 128, 4
FEATURES = 36  # entries of an initial embedding that aren't padding


def features(inv: DataFrame) -> DataFrame:
    """``id, f``: 36 numbers from the row itself (type, criticality, zone, flags, severities, sensitivity)."""
    one = lambda t: F.when(t, 1.0).otherwise(0.0)
    n = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    parts = [one(F.col("type") == t) for t in fixed.FEATURE_TYPES.split()]
    parts.append(F.col("criticality") / 5)
    parts += [one(F.col("zone") == z) for z in fixed.FEATURE_ZONES.split()]
    parts += [one(F.col("internet_facing")), one(F.col("domain_joined"))]
    parts += [F.least(n(s) / k, F.lit(1.0)) for s, k in (("critical", 3), ("high", 5), ("medium", 10), ("low", 15))]
    parts.append(fixed.switch(F.col("sensitivity"), fixed.pairs_of(fixed.SENSITIVITY), 0.5))
    return inv.select("id", "zone", F.array(*parts).alias("f"))


def initial(feats: DataFrame) -> DataFrame:
    """Features padded to ``DIM`` and scaled; deterministic (no random factor)."""
    pad = F.array_repeat(F.lit(0.0), DIM - FEATURES)
    return feats.select("id", "zone", F.transform(F.concat("f", pad), lambda x: x * math.sqrt(2 / DIM)).alias("e"))


def topology(inv: DataFrame) -> DataFrame:
    """``source, target``: the representative (smallest id) of each zone with those of the zones it reaches."""
    rep = inv.groupBy("zone").agg(F.min("id").alias("id"))
    near = fixed.small_table(inv.sparkSession, [(a, b) for a, b in fixed.reach() if a != b], "a string, b string")
    s, t = rep.select(F.col("zone").alias("a"), F.col("id").alias("source")), rep.select(F.col("zone").alias("b"), F.col("id").alias("target"))
    return s.join(near, "a").join(t, "b").select("source", "target")


def star(inv: DataFrame) -> DataFrame:
    """``source, target``: every asset with its zone's representative; links members without all their pairs."""
    rep = inv.groupBy("zone").agg(F.min("id").alias("target"))
    return inv.select(F.col("id").alias("source"), "zone").join(rep, "zone").where("source <> target").select("source", "target")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


SENT = 16_000_000  # bytes of vectors sent to every task at most; more are joined by sorting
BAND = 64.0  # softmax sums are kept per band of scores this wide, so that no exponential overflows


def attention(emb: DataFrame, edges: DataFrame, layers: int = 2, width: int = DIM) -> DataFrame:
    """``emb`` (id, e) after attention over ``edges`` in both directions; parallel edges count twice.

    Per head the weights are the softmax of the dot products with the neighbours; an embedding becomes 0.7 of
    itself and 0.3 of the weighted neighbours, read from the layer before. Nodes without neighbours stay. Entries from
    ``width`` on must be zeros: they stay zeros, so they are left off on the way and put back at the end. The ids of
    ``emb`` must be all ends of ``edges``, or more.

    A node with one neighbour takes that neighbour's embedding as it is, and is itself one summand of it; both need no
    more than the neighbour's vector beside the node's row. Links between nodes of several neighbours are joined at both
    ends. The softmax is a sum per node and band of scores, so a node with a million neighbours is a mergeable aggregate,
    not a list. Vectors compress so well that the size of their files says nothing: what is broadcast is counted first.
    """
    both = edges.select("source", "target").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    links = materialise(both.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")), "links")
    one = F.col("links") == 1
    info = links.groupBy("source").agg(F.count(F.lit(1)).alias("links"), F.min("target").alias("t"), F.min("n").alias("m"))
    info = materialise(info.select(F.col("source").alias("id"), "links", F.when(one, F.col("t")).alias("lone"), F.when(one, F.col("m")).alias("n")), "ends")
    hubs = info.where("links > 1").select("id")
    centres = materialise(hubs.union(info.where("lone IS NOT NULL").select("lone")).distinct(), "centres")
    small = centres.count() * (8 * width + 100) <= SENT
    side = F.broadcast if small else (lambda x: x.hint("merge"))
    core = links.join(side(hubs.withColumnRenamed("id", "source")), "source", "left_semi").join(side(hubs.withColumnRenamed("id", "target")), "target", "left_semi")
    core = materialise(core, "core")
    emb = materialise(emb.select("id", F.slice("e", 1, width).alias("e")).join(info.hint("merge"), "id", "left"), "embedding")
    for _ in range(layers):
        c = materialise(emb.join(side(centres), "id", "left_semi").select("id", "e"), "centre-vectors")
        beside = emb.join(side(c.select(F.col("id").alias("lone"), F.col("e").alias("le"))), "lone", "left")
        near = beside.where("le IS NOT NULL").select(F.col("lone").alias("id"), F.col("le").alias("o"), F.col("e").alias("x"), "n")
        far = core.join(side(c.select(F.col("id").alias("source"), F.col("e").alias("o"))), "source").join(side(c.select(F.col("id").alias("target"), F.col("e").alias("x"))), "target")
        mix = _softmax_mean(near.unionByName(far.select(F.col("source").alias("id"), "o", "x", "n")), width, side)
        new = beside.join(side(mix), "id", "left")
        other = F.when(F.col("links") == 1, F.col("le")).when(F.col("links") > 1, F.col("mix"))
        e = F.when(other.isNull(), F.col("e")).otherwise(F.zip_with("e", other, lambda x, y: x * 0.7 + y * 0.3))
        emb = materialise(new.select("id", e.alias("e"), "links", "lone", "n"), "embedding")
    return emb.select("id", F.concat("e", F.array_repeat(F.lit(0.0), DIM - width)).alias("e") if width < DIM else "e")


def _softmax_mean(rows: DataFrame, width: int, side) -> DataFrame:
    """``id, mix``: per head the mean of ``x`` weighted by the softmax of ``o . x``, each row counted ``n`` times.

    Summed in bands: exp(d - BAND x band) can't overflow, and bands are put together from the highest down.
    """
    size = DIM // HEADS
    heads = range(-(-width // size))
    of = [i // size for i in range(width)]
    d = [reduce(lambda a, y: a + y, [F.get("o", F.lit(i)) * F.get("x", F.lit(i)) for i in range(width) if of[i] == h]) for h in heads]
    rows = rows.select("id", "x", "n", *[c.alias(f"d{h}") for h, c in enumerate(d)])
    rows = rows.select("id", "x", *[F.floor(F.col(f"d{h}") / BAND).alias(f"b{h}") for h in heads], *[(F.col("n") * F.exp(F.col(f"d{h}") - F.floor(F.col(f"d{h}") / BAND) * BAND)).alias(f"w{h}") for h in heads])
    bands = rows.groupBy("id", *[f"b{h}" for h in heads]).agg(
        *[F.sum(f"w{h}").alias(f"w{h}") for h in heads], *[F.sum(F.col(f"w{of[i]}") * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)]
    )
    bands = materialise(bands, "bands")
    top = bands.groupBy("id").agg(*[F.max(f"b{h}").alias(f"t{h}") for h in heads])
    down = lambda h: F.exp((F.col(f"b{h}") - F.col(f"t{h}")) * BAND)
    sums = bands.join(top.hint("merge"), "id").groupBy("id").agg(*[F.sum(F.col(f"w{h}") * down(h)).alias(f"w{h}") for h in heads], *[F.sum(F.col(f"s{i}") * down(of[i])).alias(f"s{i}") for i in range(width)])
    return materialise(sums.select("id", F.array(*[F.col(f"s{i}") / F.col(f"w{of[i]}") for i in range(width)]).alias("mix")), "mix")


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


BLOCK = 4_096  # queries sent to the tasks at once


def nearest_of(queries: DataFrame, rows: DataFrame, key: str, vec: str, k: int, block: int = BLOCK) -> DataFrame:
    """``query, key, sim, rank``: the ``k`` most similar rows of each query; ties by key.

    A stated query set against all rows, in blocks: the queries are counted and dealt by hash into blocks of about
    ``block``, each broadcast on its own, so what is broadcast doesn't grow with the data; the rows are scanned once a
    block, and each task keeps its best before the shuffle.
    """
    blocks = max(1, -(-queries.count() // block))
    r = rows.select(key, F.transform(vec, lambda x: x.cast("double")).alias("rv"))
    sims = None
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else queries
        q = F.broadcast(some.select(F.col(key).alias("query"), F.transform(vec, lambda x: x.cast("double")).alias("qv")))
        part = r.join(q, F.col(key) != F.col("query")).select("query", key, F.round(cosine(F.col("qv"), F.col("rv")), 6).alias("sim"))
        sims = part if sims is None else sims.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("sim"), key)
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
