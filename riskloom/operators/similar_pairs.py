"""Scores of many pairs at once: the model of ``edges`` with the similarity in the prior, over arrays.

The same steps in the same order as the expressions of ``edges``, so that the scores are the same to the last bit. As
expressions they fill methods too long for the JVM's compiler: 28 microseconds a pair were measured.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

PAIRS = 2_000_000  # pairs scored in one group, about
SIDE = 20_000  # sources or targets in one group at most, about
TILE = 100_000  # pairs in one array


def strongest(sources: DataFrame, targets: DataFrame, key: list[str], names: tuple[str, ...], size: int, k: int) -> DataFrame:
    """``profile, kind, tgt, technique, posterior``: of each source at least the ``k`` strongest targets of its ``key``, by score, then id.

    ``sources``: ``*key, kind, sv, sn``; ``targets``: ``*key, tgt, tv, tn, com, first, bar_<profile>, part<i>, lk<i>`` with
    vectors of ``size`` entries or none, their norms, the prior's factor but for the similarity, and the thresholds. Both
    are dealt into groups by the number of pairs; where a key has targets in several groups, each gives its ``k`` strongest.
    """
    n = sources.groupBy(*key).agg(F.count(F.lit(1)).alias("ns")).join(targets.groupBy(*key).agg(F.count(F.lit(1)).alias("nt")), key)
    most = lambda *of: F.greatest(*[F.ceil(x) for x in of], F.lit(1)).cast("int")
    pairs = n.agg(F.sum(F.col("ns") * F.col("nt"))).first()[0] or 0
    parts = int(max(2 * sources.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS)))
    n = n.select(*key, most(F.col("ns") * F.col("nt") / PAIRS, F.col("ns") / SIDE).alias("sp"), most(F.col("nt") / SIDE).alias("tp"))
    by = [*key, "s", "t"]
    dealt = lambda c, into: F.pmod(F.xxhash64(c), F.col(into)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = sources.join(n, key).withColumn("s", dealt("kind", "sp")).withColumn("t", every("tp")).select(*by, "kind", "sv", "sn")
    numbers = ["tn", "com", "first", *[f"bar_{p}" for p in names], *[f"{x}{i}" for i in range(len(fixed.techniques())) for x in ("part", "lk")]]
    right = targets.join(n, key).withColumn("t", dealt("tgt", "tp")).withColumn("s", every("sp")).select(*by, "tgt", "tv", *numbers)
    # by number of partitions: bytes say nothing of the work
    both = left.repartition(parts, *by).groupBy(*by).cogroup(right.repartition(parts, *by).groupBy(*by))
    return both.applyInArrow(_scorer(names, size, k), "profile string, kind string, tgt string, technique string, posterior double")


def _scorer(names: tuple[str, ...], size: int, k: int):
    table, techniques = fixed.profiles(), [t for t, _, _ in fixed.techniques()]

    def one(column) -> pa.Array:
        c = column.combine_chunks()
        return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c

    def matrix(column) -> np.ndarray:
        """Vectors as rows; one without entries is zeros."""
        c = one(column)
        out = np.zeros((len(c), size))
        has = np.diff(c.offsets.to_numpy()) > 0
        out[has] = c.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if has.any() else 0
        return out

    def score(prior, lk):
        return np.rint(np.minimum(np.maximum(prior * 0.3 + lk * 0.7, 0.05), 0.98) * 1e9)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {c: [] for c in ("profile", "kind", "tgt", "technique", "posterior")}
        if left.num_rows and right.num_rows:
            right = right.sort_by("tgt")  # so the place of a target stands for its id
            sv, tv = matrix(left["sv"]), matrix(right["tv"])
            of = lambda c: right[c].to_numpy()
            kind, tgt = one(left["kind"]), one(right["tgt"])
            sn, m = left["sn"].to_numpy(), right.num_rows
            rows = max(1, TILE // m)
            for at in range(0, len(sv), rows):
                u = sv[at : at + rows]
                dot = np.zeros((len(u), m))
                for i in range(size):
                    dot += u[:, i, None] * tv[None, :, i]
                cosine = np.maximum(dot / (sn[at : at + rows, None] * of("tn") + 1e-8), 0.0)
                factor = of("com") * (1 + np.floor(cosine * 1e9 + 0.5) / 1e9 * 0.3)
                best = {p: np.full(dot.shape, -1.0) for p in names}
                which = {p: np.zeros(dot.shape, np.int8) for p in names}
                for i, technique in enumerate(techniques):
                    prior, lk = np.minimum(of(f"part{i}") * factor, 0.95), of(f"lk{i}")
                    ok = score(prior, lk) / 1e9 >= of("first")
                    for p in names:
                        e9 = np.where(ok, score(np.minimum(prior * table[p].get(technique, 1.0), 0.95), lk), -1.0)
                        better = e9 > best[p]
                        which[p][better], best[p][better] = i, e9[better]
                for p in names:
                    passes = best[p] / 1e9 >= of(f"bar_{p}")
                    rank = np.where(passes, (10**9 - best[p].astype(np.int64)) * m + np.arange(m), np.iinfo(np.int64).max)
                    top = np.argpartition(rank, k - 1, axis=1)[:, :k] if m > k else np.broadcast_to(np.arange(m), dot.shape)
                    r, j = np.nonzero(np.take_along_axis(passes, top, 1))
                    c = top[r, j]
                    found["profile"].append(pa.repeat(p, len(r)))
                    found["kind"].append(kind.take(pa.array(r + at)))
                    found["tgt"].append(tgt.take(pa.array(c)))
                    found["technique"].append(pa.array(techniques).take(pa.array(which[p][r, c])))
                    found["posterior"].append(pa.array(best[p][r, c] / 1e9))
        kinds = {"posterior": pa.float64()}
        return pa.table({c: pa.chunked_array(v, kinds.get(c, pa.string())) for c, v in found.items()}).combine_chunks()

    return run
