"""Subsequences, pairs and top-n against brute force, and their edge cases."""

import itertools
import math
import random
from collections import Counter

import pytest

from riskloom.llm import cooccurrence, subsequences as sub, topn
from riskloom.llm.cooccurrence import item_pairs
from riskloom.llm.subsequences import frequent_subsequences, least_count
from riskloom.llm.topn import top_n


def subsequences(seq, lo, hi, distinct):
    seq = [s for s in seq or [] if s is not None]
    out = set()
    for n in range(lo, hi + 1):
        for p in itertools.combinations(seq, n):
            if not distinct or len(set(p)) == n:
                out.add(p)
    return out


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("block,chunk,most,pairs", [(100_000, 20_000, 1_000_000, 2_000), (7, 25, 1_000_000, 2_000), (7, 25, 3, 2_000), (3, 25, 1_000_000, 2)])
def test_subsequences(spark, monkeypatch, distinct, block, chunk, most, pairs):
    monkeypatch.setattr(sub, "FEW_STEPS", pairs)
    rng = random.Random(11)
    seqs = [[rng.choice([*"abcdef", None, "x>y"]) for _ in range(rng.randrange(0, 9))] for _ in range(200)] + [None, [], [None], ["a"] * 30]
    df = spark.createDataFrame([(s, "clash") for s in seqs], "seq array<string>, pattern string").repartition(3)
    got = {tuple(r.pattern): r.support for r in frequent_subsequences(df, "seq", 0.04, 3, 2, 3, distinct, chunk_rows=chunk, block=block, blocks_at_once=2, most_steps=most).collect()}
    counts = Counter(p for s in seqs for p in subsequences(s, 2, 3, distinct))
    least = least_count(0.04, len(seqs), 3)
    assert got == {p: n for p, n in counts.items() if n >= least} and got


def test_subsequences_edges(spark):
    empty = spark.createDataFrame([], "s array<string>")
    assert frequent_subsequences(empty, "s", 0.5).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([None],)], "s array<string>")
    assert frequent_subsequences(nulls, "s", 0.1).count() == 0
    long = spark.createDataFrame([([f"e{i % 5}" for i in range(20_000)],)] * 2, "s array<string>")
    assert frequent_subsequences(long, "s", 1.0, 2, 2, 2).count() == 20
    assert least_count(0.44, 100, 5) == 44 and least_count(0.03, 10, 5) == 5 and least_count(0.1, 30) == 3


@pytest.mark.parametrize("literal", [4_096, 2])
def test_pairs(spark, monkeypatch, literal):
    monkeypatch.setattr(cooccurrence, "FEW_ITEMS", literal)
    rng = random.Random(2)
    rows = [(i, [rng.choice([*"abcdefgh", None]) for _ in range(rng.randrange(0, 7))]) for i in range(150)] + [(900, None), (None, ["a", "b"]), (901, list("abcdefgh") * 500)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "basket int, items array<string>, k int, n string")
    got = {(r.a, r.b): r for r in item_pairs(df, "basket", "items", 0.02, 3).collect()}
    sets = [{x for x in s or [] if x is not None} for b, s in rows if b is not None]
    n, single = len(sets), Counter(x for s in sets for x in s)
    pairs = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    want = {p: c for p, c in pairs.items() if c >= least_count(0.02, n, 3)}
    assert {p: r.n_ab for p, r in got.items()} == want and want
    for (a, b), r in got.items():
        lift = r.n_ab * n / (single[a] * single[b])
        assert (r.n, r.n_a, r.n_b) == (n, single[a], single[b]) and abs(r.lift - lift) < 1e-9 and abs(r.pmi - math.log(lift)) < 1e-9


def test_pairs_empty(spark):
    assert item_pairs(spark.createDataFrame([], "b int, items array<string>"), "b", "items").count() == 0
    assert item_pairs(spark.createDataFrame([(1, None), (2, [])], "b int, items array<string>"), "b", "items").count() == 0


def test_top_n(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), f"i{i}", rng.choice([1.0, 2.0, 2.5, float("nan"), None, -0.0, 0.0]), "clash") for i in range(2_000)]
    rows += [("solo", "z", -5.0, "x"), ("none", "y", None, "x"), ("n2", None, 1.0, "x")]
    df = spark.createDataFrame(rows, "grp string, id string, score double, rank string").repartition(5)
    got = {}
    for r in top_n(df, "grp", "score", "id", 3).collect():
        got.setdefault(r.grp, {})[r["rank"]] = r.id
    want = {}
    for g in {r[0] for r in rows} - {None}:
        best = sorted((-r[2], r[1]) for r in rows if r[0] == g and r[1] is not None and r[2] is not None and r[2] == r[2])[:3]
        if best:
            want[g] = {i: b[1] for i, b in enumerate(best, 1)}
    assert got == want
    assert top_n(df.limit(0), "grp", "score", "id", 3).count() == 0
    twice = top_n(spark.createDataFrame([("g", "a", 1.0)] * 4, "g string, id string, s double"), "g", "s", "id", 3)
    assert [r["rank"] for r in twice.collect()] == [1, 2, 3]


def test_rare_steps_make_no_candidates():
    """A chunk whose local support is 1 grows patterns inside the frequent pairs only."""
    import pyarrow as pa

    rows = [[f"r{i}" for i in range(60)] + ["a", "b", "c", "d"]]
    chunk = sub.Chunk([pa.array(rows)])
    chunk.keep(set("abcd"))
    found = {tuple(chunk.names[c] for c in p) for p, _ in sub.mine(chunk, 1, 3, 4, True, chunk.matrix({("a", "b"), ("a", "c"), ("b", "c")}))}
    assert found == {("a", "b", "c")}


def test_counts_beyond_bigint(spark):
    from pyspark.sql import functions as F

    n = 4_000_000_000
    df = spark.createDataFrame([(n // 2, n, n // 2, n // 2)], "n_ab bigint, n bigint, n_a bigint, n_b bigint")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    assert df.where(big("n_ab") * big("n") >= 2 * (big("n_a") * big("n_b"))).count() == 1


def test_both_heaps_agree(spark):
    """The heap is Spark's own since 4.1; without it the window takes over with the same result."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    slim = spark.createDataFrame([(rng.choice("ab"), (float(rng.randrange(9)), i)) for i in range(300)], "g string, e struct<down:double,id:int>").repartition(4)
    sets = [{r.g: sorted(map(tuple, r.top)) for r in topn.heaps(slim, 4, h).select("g", F.col("top")).collect()} for h in (topn._heap, None)]
    assert sets[0] == sets[1] and topn._heap is not None, "collect_top_k is gone from this version of PySpark; top_n uses the window"
