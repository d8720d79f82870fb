"""Transitions between assets: prior x evidence, thresholds, and the strongest neighbours of every asset.

A transition's score depends on the source only through its zone and two flags. So every target is scored in the few
situations a source can be in, the best targets are ranked once per zone and situation, and all sources of a class
(zone and flags) share the merged ranking of the zones they reach. That is exact and linear in the number of assets;
no pair of assets is built but those that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..session import materialise
from .similar_pairs import strongest

K = 20
PROFILES = ("apt", "ransomware", "insider")


def threshold(criticality: Column, zone: Column, dist: Column) -> Column:
    floor = F.lit(0.50) - fixed.switch(criticality, {5: 0.15, 4: 0.10, 3: 0.05}, 0.0)
    floor = floor - F.when(zone.isin(*fixed.SENSITIVE_ZONES.split()), 0.08).otherwise(0.0) + F.when(dist >= 2, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.25), F.least(F.lit(0.55), floor))


def _serves(category: Column, technique: str) -> Column:
    """Whether findings of a category are evidence for a technique; unknown categories are for all."""
    named = fixed.groups(fixed.CATEGORY_TECHNIQUES)
    mine = [c for c, ts in named if technique in ts]
    known = [c for c, _ in named]
    return category.isin(*mine) | ~F.coalesce(category.isin(*known), F.lit(False))


def evidence_likelihood(technique: str) -> Column:
    """The likelihood of one technique from the row's own findings; see ``likelihoods``."""
    rel = F.filter("findings", lambda f: _serves(f["category"], technique))
    n = F.size(rel)
    crit = F.size(F.filter(rel, lambda f: (f["severity"] == "critical") & f["exploit_available"]))
    high = F.size(F.filter(rel, lambda f: f["severity"] == "high"))
    lk = F.least(n * 0.15 + crit * 0.25 + high * 0.1, F.lit(0.95))
    lk = F.when(F.col("siem") > 0, F.least(lk + F.col("siem") * 0.1, F.lit(0.95))).otherwise(lk)
    lk = F.when(F.col("intel") > 0, F.least(lk + F.col("intel") * 0.05, F.lit(0.95))).otherwise(lk)
    return F.when(n == 0, 0.3).otherwise(lk)


def likelihoods(inv: DataFrame) -> DataFrame:
    """``asset_id, technique, likelihood``: row-local over the finding list, no shuffle."""
    rows = F.array(*[F.struct(F.lit(t).alias("technique"), evidence_likelihood(t).alias("likelihood")) for t, _, _ in fixed.techniques()])
    return inv.select(F.col("id").alias("asset_id"), F.explode(rows).alias("r")).select("asset_id", "r.*")


def affinity(technique: str) -> Column:
    out = F.lit(1.0)
    for row in reversed(fixed.AFFINITY_TYPES.strip().splitlines()):
        t, factor, *types = row.split()
        if t == technique:
            out = F.when(F.col("type").isin(*types), float(factor)).otherwise(out)
    t, factor, *zones = fixed.AFFINITY_ZONES.split()
    return F.when(F.col("zone").isin(*zones), float(factor)).otherwise(out) if t == technique else out


def _targets(inv: DataFrame) -> DataFrame:
    exploitable = F.size(F.filter("findings", lambda f: f["exploit_available"] & (f["severity"] == "critical")))
    cols = []
    for i, (t, base, _) in enumerate(fixed.techniques()):
        part = F.lit(base) * (1 + F.col("criticality") * 0.08) * (1 + exploitable * 0.15) * affinity(t)
        cols += [part.alias(f"part{i}"), evidence_likelihood(t).alias(f"lk{i}")]
    return inv.select(F.col("id").alias("tgt"), F.col("zone").alias("tgt_zone"), F.col("criticality").alias("tgt_criticality"), F.col("domain_joined").alias("tgt_domain"), *cols)


def classes(inv: DataFrame) -> DataFrame:
    """Source classes with their number of members."""
    return inv.groupBy(F.col("zone").alias("src_zone"), F.col("internet_facing").alias("src_internet"), F.col("domain_joined").alias("src_domain")).agg(F.count(F.lit(1)).alias("members"))


def reached_zones(c: DataFrame) -> DataFrame:
    """Every class with every zone it reaches: ``*c, tgt_zone, dist``.

    A zone that isn't in the reach table (misspelt, unknown) reaches itself only.
    """
    hops = fixed.zone_distances()
    near = fixed.small_table(c.sparkSession, [(a, b, hops.get((a, b), 99)) for a, b in fixed.reach()], "src_zone string, tgt_zone string, dist int")
    known = [z for z, _ in fixed.groups(fixed.ZONE_REACH)]
    alone = c.where(~F.col("src_zone").isin(*known)).withColumns({"tgt_zone": F.col("src_zone"), "dist": F.lit(0)})
    return c.join(near, "src_zone").unionByName(alone)


def _score(prior: Column, i: int) -> Column:
    """Prior and evidence of technique ``i`` combined, to nine decimals so that equal scores are ties."""
    raw = F.least(F.greatest(prior * 0.3 + F.col(f"lk{i}") * 0.7, F.lit(0.05)), F.lit(0.98))
    return F.rint(raw * 1e9) / 1e9


SITUATION = ["tgt_zone", "tgt_domain", "dist", "src_internet", "both"]


def situations(inv: DataFrame, names: tuple[str, ...] = PROFILES) -> DataFrame:
    """``profile, tgt, *SITUATION, technique, posterior``: the best technique against a target in each situation.

    What a score needs to know of its source is how far its zone is (zones that reach one another are 0 or 1 hops
    apart), whether it faces the internet, and whether both assets are joined to the domain: at most eight situations
    a target, whatever the number of sources. Techniques that fail the first threshold are out before any profile is
    looked at; of the rest the best under the profile counts (the first on ties), if it passes the second threshold.
    """
    return _best(_in_situations(inv).withColumn("common", _common()), names, ["tgt", *SITUATION])


def _in_situations(inv: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    ways = [F.struct(F.lit(d).alias("dist"), F.lit(i).alias("src_internet"), F.lit(b).alias("both")) for b in (False, True) for d in (0, 1) for i in (False, True)]
    plain = F.slice(F.array(*ways), 1, 4)
    t = _targets(inv) if targets is None else targets
    return t.select(*t.columns, F.explode(F.when(F.col("tgt_domain"), F.array(*ways)).otherwise(plain)).alias("w")).select(*t.columns, "w.*")


def _common() -> Column:
    return F.when(F.col("dist") == 0, 1.0).otherwise(0.6) * F.when(F.col("src_internet"), 1.4).otherwise(1.0) * F.when(F.col("both"), 1.2).otherwise(1.0)


def _best(rows: DataFrame, names: tuple[str, ...], keep: list[str]) -> DataFrame:
    """``profile, *keep, technique, posterior``: both thresholds, and the best technique of each row under each profile."""
    table, techniques = fixed.profiles(), fixed.techniques()
    n = range(len(techniques))
    first = threshold(F.col("tgt_criticality"), F.col("tgt_zone"), F.col("dist")) - 1e-9
    second = threshold(F.col("tgt_criticality"), F.col("tgt_zone"), F.lit(0)) - 1e-9
    rows = rows.withColumns({"first": first, "second": second})
    rows = rows.withColumns({f"prior{i}": F.least(F.col(f"part{i}") * F.col("common"), F.lit(0.95)) for i in n})
    rows = rows.withColumns({f"ok{i}": _score(F.col(f"prior{i}"), i) >= F.col("first") for i in n})
    posts = {f"{p}{i}": F.when(F.col(f"ok{i}"), _score(F.least(F.col(f"prior{i}") * table[p].get(t_, 1.0), F.lit(0.95)), i)) for p in names for i, (t_, _, _) in enumerate(techniques)}
    rows = rows.select(*keep, "second", *[c.alias(k) for k, c in posts.items()])
    rows = rows.withColumns({f"{p}_top": F.greatest(*[F.col(f"{p}{i}") for i in n]) for p in names})
    each = []
    for p in names:
        which = F.coalesce(*[F.when(F.col(f"{p}{i}") == F.col(f"{p}_top"), t_) for i, (t_, _, _) in enumerate(techniques)])
        each.append(F.struct(F.lit(p).alias("profile"), which.alias("technique"), F.col(f"{p}_top").alias("posterior")))
    return rows.select(*keep, "second", F.explode(F.array(*each)).alias("p")).where("p.posterior >= second").select("p.profile", *keep, "p.technique", "p.posterior")


FLAGS = ["src_zone", "src_internet", "src_domain"]


def target_kinds(inv: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """``_targets`` with their vector ``v``, one row for all that agree in everything but the id: ``tgt`` the smallest id, ``ids`` the ``k + 1`` smallest.

    Targets of a kind have the same score from any source, so no other of them can be among a source's ``k`` strongest
    (the source itself may be one of the ``k + 1``). The window keeps the first ids before its shuffle.
    """
    plain = _targets(inv)
    t = plain.join(vectors.hint("merge"), F.col("tgt") == F.col("id"), "left").select(*plain.columns, F.coalesce("v", F.array().cast("array<double>")).alias("v"))
    kind = [c for c in t.columns if c != "tgt"]
    t = t.withColumn("h", F.xxhash64(*kind))  # first in the sort, so that rows are seldom compared further
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("h", *kind).orderBy("tgt"))).where(F.col("r") <= k + 1)
    return first.groupBy("h", *kind).agg(F.array_sort(F.collect_list("tgt")).alias("ids")).select(F.get("ids", F.lit(0)).alias("tgt"), "ids", *kind)


def _similar_bars(inv: DataFrame, targets: DataFrame, names: tuple[str, ...], k: int) -> DataFrame:
    """``profile, *FLAGS, bar, bar_tgt``: the class's ``k + 1``-th strongest target at similarity 0; classes with fewer have no row."""
    order = [F.desc("posterior"), "tgt"]
    # written: the expressions are long, and every step on top of them would be planned with them again
    least = materialise(_best(_in_situations(inv, targets).withColumn("common", _common()), names, ["tgt", *SITUATION]), "least")
    c = reached_zones(classes(inv).drop("members")).withColumn("tgt_domain", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("both", _both())
    best = least.withColumn("r", F.row_number().over(Window.partitionBy("profile", *SITUATION).orderBy(*order))).where(F.col("r") <= k + 1)
    mine = c.join(best, SITUATION).select("profile", *FLAGS, "tgt", "posterior")
    place = F.row_number().over(Window.partitionBy("profile", *FLAGS).orderBy(*order))
    if "ids" in targets.columns:
        mine = mine.withColumn("r", place).where(F.col("r") <= k + 1).join(targets.select("tgt", "ids"), "tgt").select("profile", *FLAGS, F.explode("ids").alias("tgt"), "posterior")
    mine = mine.withColumn("r", place).where(F.col("r") == k + 1)
    return materialise(mine.select("profile", *FLAGS, F.col("posterior").alias("bar"), F.col("tgt").alias("bar_tgt")), "bars")


def similar_candidates(inv: DataFrame, targets: DataFrame, names: tuple[str, ...] = PROFILES, k: int = K, bars: DataFrame | None = None) -> DataFrame:
    """``*FLAGS, tgt, dist``: the targets that may be among the ``k`` strongest of some source of the class, whatever the similarity.

    A score never falls as the similarity rises from 0 to 1, rounding included. So at least ``k`` targets other than the
    source are as strong as the class's ``k + 1``-th at similarity 0 (by score, then id), and a target that comes after
    that one even at similarity 1 is out. Exact; linear in the assets. Classes with fewer targets keep all that pass.
    ``targets`` are single ones, or kinds (``target_kinds``).
    """
    bars = _similar_bars(inv, targets, names, k) if bars is None else bars
    most = materialise(_best(_in_situations(inv, targets).withColumn("common", _common() * (1 + F.lit(1.0) * 0.3)), names, ["tgt", *SITUATION]), "most")
    c = reached_zones(classes(inv).drop("members")).withColumn("tgt_domain", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("both", _both())
    c = c.crossJoin(fixed.small_table(inv.sparkSession, [(p,) for p in names], "profile string")).join(bars, ["profile", *FLAGS], "left")
    stays = F.col("bar").isNull() | (F.col("posterior") > F.col("bar")) | ((F.col("posterior") == F.col("bar")) & (F.col("tgt") <= F.col("bar_tgt")))
    return most.join(c, ["profile", *SITUATION]).where(stays).select(*FLAGS, "tgt", "dist").distinct()


def similar_adjacency(inv: DataFrame, vectors: DataFrame, names: tuple[str, ...] = PROFILES, k: int = K) -> DataFrame:
    """``adjacency`` with the similarity of both assets in the prior: times 1 + 0.3 x cosine, where that is above 0.

    ``vectors``: ``id, v``, one array of finite doubles of one length per asset; without one the similarity is 0. Similarity
    belongs to the pair, so pairs are scored, but pairs of kinds: sources of one class and vector share their ranking, and
    targets that agree in all but the id are one (``target_kinds``). A source meets only the targets that can be among the
    strongest of its class (``similar_candidates``), not all that its zone reaches.
    """
    vectors = materialise(vectors.select("id", "v"), "vectors")
    size = vectors.select(F.max(F.size("v"))).first()[0] or 0
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    members = inv.select(F.col("id").alias("src"), F.col("zone").alias("src_zone"), F.col("internet_facing").alias("src_internet"), F.col("domain_joined").alias("src_domain"))
    members = members.join(vectors.hint("merge"), F.col("src") == F.col("id"), "left").select("src", *FLAGS, F.coalesce("v", F.array().cast("array<double>")).alias("sv"))
    members = materialise(members, "members")
    sources = materialise(members.groupBy(*FLAGS, "sv").agg(F.min("src").alias("kind")).withColumn("sn", norm("sv")), "sources")
    kinds = materialise(target_kinds(inv, vectors, k), "targets")
    bars = _similar_bars(inv, kinds, names, k)
    chosen = similar_candidates(inv, kinds, names, k, bars)
    chosen = kinds.drop("ids").withColumnRenamed("v", "tv").withColumn("tn", norm("tv")).join(chosen.hint("merge"), "tgt")
    per = bars.groupBy(*FLAGS).agg(*[F.max(F.when(F.col("profile") == p, F.col("bar"))).alias(f"bar_{p}") for p in names])
    second = threshold(F.col("tgt_criticality"), F.col("tgt_zone"), F.lit(0)) - 1e-9
    chosen = chosen.join(per, FLAGS, "left").withColumns({f"bar_{p}": F.greatest(second, f"bar_{p}") for p in names})
    chosen = chosen.withColumn("first", threshold(F.col("tgt_criticality"), F.col("tgt_zone"), F.col("dist")) - 1e-9)
    chosen = materialise(chosen.withColumn("both", _both()).withColumn("com", _common()), "candidates")
    best = materialise(strongest(sources, chosen, FLAGS, names, size, k + 1), "best-kinds")
    # their ids: a list has (k + 1) x (k + 1) entries of each group of targets at most
    best = best.join(kinds.select("tgt", "ids"), "tgt")
    lists = best.groupBy("profile", "kind").agg(F.collect_list(F.struct((-F.col("posterior")).alias("minus"), "ids", "technique")).alias("b"))
    one = F.flatten(F.transform("b", lambda x: F.transform(x["ids"], lambda t: F.struct(x["minus"].alias("minus"), t.alias("tgt"), x["technique"].alias("technique")))))
    lists = lists.select("profile", "kind", F.slice(F.array_sort(one), 1, k + 1).alias("best")).join(sources.select("kind", *FLAGS, "sv"), "kind").drop("kind")
    lists = materialise(lists.withColumn("tgts", F.col("best.tgt")), "rankings")
    own = members.join(lists, [*FLAGS, "sv"]).select("profile", "src", F.array_position("tgts", F.col("src")).alias("own"), F.posexplode("best").alias("r", "b"))
    place = F.col("r") + 1 - F.when((F.col("own") > 0) & (F.col("own") < F.col("r") + 1), 1).otherwise(0)
    return own.where("b.tgt <> src").select("profile", "src", "b.tgt", "b.technique", (-F.col("b.minus")).alias("posterior"), place.cast("int").alias("k")).where(F.col("k") <= k)


def pruned(inv: DataFrame) -> DataFrame:
    """One row: ``candidates`` (pairs that reach one another, times techniques), ``passed`` the first threshold, ``pruned``.

    Counted by zone and situation like ``edge_statistics``; no pair is built.
    """
    techniques = fixed.techniques()
    rows = _in_situations(inv)
    first = threshold(F.col("tgt_criticality"), F.col("tgt_zone"), F.col("dist")) - 1e-9
    ok = sum((F.when(_score(F.least(F.col(f"part{i}") * _common(), F.lit(0.95)), i) >= first, 1).otherwise(0) for i in range(1, len(techniques))), F.when(_score(F.least(F.col("part0") * _common(), F.lit(0.95)), 0) >= first, 1).otherwise(0))
    s = rows.select("tgt", *SITUATION, ok.alias("ok"))
    per = s.groupBy(*SITUATION).agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok"))
    c = reached_zones(classes(inv)).withColumn("tgt_domain", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("both", _both())
    all_ = c.join(per, SITUATION).agg(F.sum(F.col("members") * F.col("n")).alias("n"), F.sum(F.col("members") * F.col("ok")).alias("ok"))
    me = inv.select(F.col("id").alias("tgt"), F.col("internet_facing").alias("mine"))
    own = s.where("dist = 0 AND both = tgt_domain").join(me, "tgt").where("src_internet = mine").agg(F.count(F.lit(1)).alias("n1"), F.sum("ok").alias("ok1"))
    out = all_.crossJoin(own)  # one row each
    zero = F.lit(0)
    total, passed = (F.coalesce("n", zero) - F.coalesce("n1", zero)) * len(techniques), F.coalesce("ok", zero) - F.coalesce("ok1", zero)
    return out.select(total.alias("candidates"), passed.alias("passed"), (total - passed).alias("pruned"))


def _both() -> Column:
    return F.col("src_domain") & F.col("tgt_domain")


def adjacency(inv: DataFrame, names: tuple[str, ...] = PROFILES, k: int = K) -> DataFrame:
    """``profile, src, tgt, technique, posterior, k``: the ``k`` strongest neighbours of every asset.

    Ties by target id. Ranked to ``k + 1`` (an asset may be its own target) once per target zone and situation, with
    a window that keeps only the first rows before its shuffle; a class merges the rankings of the zones it reaches
    and shares the result among its members.
    """
    order = [F.desc("posterior"), "tgt"]
    best = situations(inv, names).withColumn("r", F.row_number().over(Window.partitionBy("profile", *SITUATION).orderBy(*order))).where(F.col("r") <= k + 1)
    c = reached_zones(classes(inv).drop("members")).withColumn("tgt_domain", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("both", _both())
    flags = ["src_zone", "src_internet", "src_domain"]
    mine = c.join(best, SITUATION).select("profile", *flags, "tgt", "technique", "posterior")
    mine = mine.withColumn("r", F.row_number().over(Window.partitionBy("profile", *flags).orderBy(*order))).where(F.col("r") <= k + 1)
    ranked = mine.groupBy("profile", *flags).agg(F.array_sort(F.collect_list(F.struct("r", "tgt", "technique", "posterior"))).alias("best"))
    ranked = ranked.withColumn("tgts", F.col("best.tgt"))
    members = inv.select(F.col("id").alias("src"), F.col("zone").alias("src_zone"), F.col("internet_facing").alias("src_internet"), F.col("domain_joined").alias("src_domain"))
    own = members.join(ranked, flags).select("profile", "src", F.array_position("tgts", F.col("src")).alias("own"), F.explode("best").alias("b"))
    place = F.col("b.r") - F.when((F.col("own") > 0) & (F.col("own") < F.col("b.r")), 1).otherwise(0)
    return own.where("b.tgt <> src").select("profile", "src", "b.tgt", "b.technique", "b.posterior", place.alias("k")).where(F.col("k") <= k)


BLOCK = 3_000  # sources, and scored targets, that are listed with one another in one group, about


def all_transitions(inv: DataFrame, names: tuple[str, ...] = PROFILES) -> DataFrame:
    """``profile, src, tgt, technique, posterior``: every transition that passes, not the strongest alone.

    An equi-join of sources with the situations of the zones they reach; the result itself is quadratic in the
    members of a zone, so it is for listings of a part; ``edge_statistics`` counts without building it. Both sides are
    dealt into groups of ``BLOCK`` rows, so no task lists a whole zone, and what a file repeats for every source is short
    enough for its compression to find.
    """
    s = inv.select(F.col("id").alias("src"), F.col("zone").alias("src_zone"), F.col("internet_facing").alias("src_internet"), F.col("domain_joined").alias("src_domain"))
    s = reached_zones(s).withColumn("tgt_domain", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("both", _both()).select("src", *SITUATION)
    t = materialise(situations(inv, names), "situations")
    n = s.groupBy(*SITUATION).agg(F.count(F.lit(1)).alias("ns")).join(t.groupBy(*SITUATION).agg(F.count(F.lit(1)).alias("nt")), SITUATION)
    n = materialise(n, "sizes")
    rows = n.agg(F.sum(F.col("ns") * F.col("nt"))).first()[0] or 0
    tasks = int(max(2 * inv.sparkSession.sparkContext.defaultParallelism, -(-rows // (BLOCK * BLOCK))))
    n = n.select(*SITUATION, F.ceil(F.col("ns") / BLOCK).cast("int").alias("sp"), F.ceil(F.col("nt") / BLOCK).cast("int").alias("tp"))
    by, every = [*SITUATION, "a", "b"], lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = s.join(n, SITUATION).withColumn("a", F.pmod(F.xxhash64("src"), F.col("sp")).cast("int")).withColumn("b", every("tp"))
    right = t.join(n, SITUATION).withColumn("b", F.pmod(F.xxhash64("tgt"), F.col("tp")).cast("int")).withColumn("a", every("sp"))
    # by number of tasks: bytes say nothing of the rows to come
    both = left.drop("sp", "tp").repartition(tasks, *by).hint("merge").join(right.drop("sp", "tp").repartition(tasks, *by), by)
    return both.where("src <> tgt").select("profile", "src", "tgt", "technique", "posterior")


def edge_statistics(inv: DataFrame, names: tuple[str, ...] = PROFILES) -> DataFrame:
    """``profile, nodes, edges, avg_posterior, branching``: all edges that pass, counted without building them.

    The targets that pass are counted per zone and situation; a class has them once per member, and every asset that
    would be its own target is taken off again.
    """
    s = situations(inv, names)
    per = s.groupBy("profile", *SITUATION).agg(F.count(F.lit(1)).alias("n"), F.sum("posterior").alias("mass"))
    c = reached_zones(classes(inv)).withColumn("tgt_domain", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("both", _both())
    all_ = c.join(per, SITUATION).groupBy("profile").agg(F.sum(F.col("members") * F.col("n")).alias("edges"), F.sum(F.col("members") * F.col("mass")).alias("mass"))
    me = inv.select(F.col("id").alias("tgt"), F.col("internet_facing").alias("mine"))
    own = s.where("dist = 0 AND both = tgt_domain").join(me, "tgt").where("src_internet = mine").groupBy("profile").agg(F.count(F.lit(1)).alias("less"), F.sum("posterior").alias("less_mass"))
    both = all_.join(own, "profile", "left")
    nodes = inv.agg(F.count(F.lit(1)).alias("nodes"))
    n, mass = F.col("edges") - F.coalesce("less", F.lit(0)), F.col("mass") - F.coalesce("less_mass", F.lit(0.0))
    out = both.crossJoin(nodes).withColumns({"n": n, "m": mass}).where("n > 0")  # one row beside three
    return out.select("profile", "nodes", F.col("n").alias("edges"), F.round(F.try_divide("m", F.col("n")), 6).alias("avg_posterior"), F.round(F.col("n") / F.greatest("nodes", F.lit(1)), 6).alias("branching"))
