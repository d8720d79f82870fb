"""Filling missing values by predictive mean matching within groups.

Three steps, the same for every field: a group-aware predictor gives each missing cell a prediction (``_centres``,
``_predictions``), a range search finds the observed rows next to it (``_nearest``), and what these hold is copied, with
their ids (``_result``); a cell no donor is found for isn't filled. All statistics are built from counts combined before
the shuffle, medians and donors by ranges of values, so a group holding a third of all rows is never in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise


@dataclass(frozen=True)
class Numeric:
    """A numeric field: values in ``low..high`` are known, all else is missing."""

    low: float
    high: float
    covariate: str | None = None  # another numeric field that sharpens the prediction within a group
    bands: Sequence[tuple[str, float | None]] = ()  # (label, exclusive upper bound), the last bound None

    def known(self, c: Column) -> Column:
        return F.when(c.between(self.low, self.high) & ~F.isnan(c), c.cast("double"))

    def place(self, c: Column) -> Column:
        """Where a known value stands among the others: a number."""
        return c

    def text(self, c: Column) -> Column:
        """The value at a place, as text."""
        return c.cast("string")

    def label(self, c: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, below in reversed(self.bands):
            out = F.lit(name) if below is None else F.when(c < below, name).otherwise(out)
        return F.when(c.isNotNull(), out)

    def step(self, c: Column, steps: int) -> Column:
        """Which of ``steps`` equal ranges over ``low..high`` a value is in; values outside are in the outer ones."""
        s = F.floor((c - self.low) / (self.high - self.low) * steps).cast("int")
        return F.greatest(F.least(s, F.lit(steps - 1)), F.lit(0))


@dataclass(frozen=True)
class Category:
    """A categorical field; ``values`` in order of precedence for ties, compared in any case without outer blanks."""

    values: Sequence[str]

    def known(self, c: Column) -> Column:
        clean = F.lower(F.trim(c))
        return F.when(clean.isin(*self.values), clean)

    def place(self, c: Column) -> Column:
        """Where a known value stands among the others: its number in ``values``, from 1."""
        return F.when(c.isNotNull(), F.array_position(F.array(*[F.lit(v) for v in self.values]), c).cast("double"))

    def text(self, c: Column) -> Column:
        """The value at a place."""
        return F.coalesce(*[F.when(c == i, v) for i, v in enumerate(self.values, 1)])  # element_at takes a null place for the last

    label = text

    def step(self, c: Column, steps: int) -> Column:
        """A range for each value."""
        return c.cast("int")


RANGES = 1_024  # ranges of values a group's values are counted in before its median and the rows next to it are sought in some of them
STEPS = 256  # ranges of predictions donors are sought in
_EPS = 9  # decimals kept of a median before it is put in a band


def fill_missing(df: DataFrame, key: str, group: Sequence[str], fields: Mapping[str, Numeric | Category], name: str = "cells", back_off: bool = True) -> DataFrame:
    """One row per missing cell: ``key, field, level, predicted, donor_id, donor_id_2, filled, label``.

    ``group`` are the grouping columns from coarse to fine. The finest group with a known value decides
    (``level`` = number of grouping columns used, 0 the whole table); a row with a null in a grouping column
    starts at the level before it. Without ``back_off`` the finest groups alone count. Where no group knows the
    field, ``level`` and all fills are null. ``filled`` is copied from donors of the cell's group, ``label`` is its
    band (numeric) or the value itself.

    * numeric: the prediction is the group's median. The donors are found by a range search among the group's
      observed values: the nearest from below and from above (the smallest keys that hold them); ``filled`` is
      their mean, which is the one value where both are the same (``donor_id_2`` is null then).
    * numeric with a covariate: a slope on the covariate, fitted within the coarsest groups and pooled, is added.
      Rows with a value have their own predictions. A range search as above finds the two next to the cell's; the
      donor is the one fewer steps away (``STEPS`` over ``low..high``), then the nearer, then the lower one, then the
      smallest key, ``filled`` its observed value. Where the covariate isn't known it adds nothing.
    * categorical: the prediction is the most frequent value (ties: the earlier in ``values``), the donor the
      smallest key that has it, found by the same search.

    Input rows must have one row per key; null keys are left out. Extra columns are ignored. No rows, no cells.
    """
    nums = {f: s for f, s in fields.items() if isinstance(s, Numeric)}
    base = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__id"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], *[s.known(F.col(f)).alias(f) for f, s in fields.items()]
    )
    base = materialise(base, name)
    g = [f"__g{i}" for i in range(len(group))]
    levels = [g[:n] for n in range(len(g), -1, -1)] if back_off else [g]  # fine to coarse
    parts = [F.struct(F.lit(f).alias("field"), s.place(F.col(f)).alias("at")) for f, s in fields.items()]
    known = base.select(F.col("__id").alias("id"), *g, F.explode(F.array(*parts)).alias("c")).select("id", *g, "c.*").where("at IS NOT NULL")
    known = known.withColumns({"range": _step_of(F.col("at"), fields, RANGES), "v": F.col("at")})
    spans = materialise(known.groupBy(*g, "field", "range").agg(F.count(F.lit(1)).alias("n"), *_ends()), f"{name}-ranges")
    spans = [_rolled(spans, keys, g) for keys in levels]
    centres = _centres(known, spans, levels, fields, name)

    parts = [F.struct(F.lit(f).alias("field"), F.col(f).isNull().alias("miss")) for f in fields]
    matched = [f for f, s in nums.items() if s.covariate in nums]
    if matched:
        own = _predictions(base, g, centres[0], matched, nums)
        parts = [F.struct(F.lit(f).alias("field"), F.col(f).isNull().alias("miss"), (F.col(f"{f}__p") if f in matched else F.lit(None).cast("double")).alias("own")) for f in fields]
    else:
        own = base
    missing = own.select("__id", *g, F.explode(F.array(*parts)).alias("c")).where("c.miss").select("__id", *g, "c.field", *(["c.own"] if matched else []))
    by_group = ~F.col("field").isin(*matched)  # one prediction a group: its donors are those of all its cells
    for keys, span, centre in zip(levels, spans, centres):
        n = len(keys)
        want = centre.where(by_group).withColumn("range", _step_of(F.col("at"), fields, RANGES))
        found = _nearest(known.where(by_group), span.where(by_group), want, keys)
        right = centre.join(found.drop("at"), [*keys, "field"], "left")
        right = right.select(*[F.col(k).alias(f"{k}_r") for k in keys], F.col("field").alias("field_r"), F.struct("at", "low", "high").alias(f"m{n}"))
        on = F.col("field") == F.col("field_r")
        for k in keys:
            on = on & (F.col(k) == F.col(f"{k}_r"))
        missing = missing.join(right, on, "left").drop("field_r", *[f"{k}_r" for k in keys])
    sizes = [len(k) for k in levels]
    level = F.coalesce(*[F.when(F.col(f"m{n}").isNotNull(), n) for n in sizes])
    missing = missing.select("__id", *g, "field", *(["own"] if matched else []), level.alias("level"), F.coalesce(*[F.col(f"m{n}") for n in sizes]).alias("m"))
    middle = F.round("m.at", _EPS)
    if not matched:
        return _result(missing, key, fields, middle, F.col("m.low"), F.col("m.high"))
    missing = missing.withColumn("own", F.when(F.col("level").isNotNull() & ~by_group, F.coalesce("own", "m.at")))
    missing = materialise(missing, f"{name}-missing")  # read for the donors that are wanted, and for the result
    found = _donors(own, missing, g, levels, {f: nums[f] for f in matched}, name)
    on = (F.col("level") == F.col("level_d")) & (F.col("field") == F.col("field_d")) & (F.col("own") == F.col("at_d"))
    for i, k in enumerate(g):
        on = on & F.when(F.col("level") > i, F.col(k)).eqNullSafe(F.col(f"{k}_d"))
    rows = missing.join(found, on, "left")
    return _result(rows, key, fields, F.when(by_group, middle).otherwise(F.col("own")), F.when(by_group, F.col("m.low")).otherwise(F.col("d")), F.when(by_group, F.col("m.high")))


def _result(rows: DataFrame, key: str, fields, predicted: Column, low: Column, high: Column) -> DataFrame:
    """What the donors hold, copied: the mean of both, or what the first holds where the second is null."""
    rows = rows.select("__id", "field", "level", predicted.alias("p"), low.alias("low"), high.alias("high"))
    value = F.when(F.col("high").isNull(), F.col("low.v")).otherwise(F.round((F.col("low.v") + F.col("high.v")) / 2, _EPS))
    rows = rows.withColumn("value", value)
    of = lambda m, c: F.coalesce(*[F.when(F.col("field") == f, getattr(s, m)(F.col(c))) for f, s in fields.items()])
    return rows.select(
        F.col("__id").alias(key), "field", "level", of("text", "p").alias("predicted"), F.col("low.id").alias("donor_id"),
        F.when(F.col("high.id") != F.col("low.id"), F.col("high.id")).alias("donor_id_2"), of("text", "value").alias("filled"), of("label", "value").alias("label"),
    )


def _ends() -> list[Column]:
    return [F.min("at").alias("bottom"), F.max("at").alias("top")]


def _rolled(spans: DataFrame, keys, g) -> DataFrame:
    """Ranges of the finest groups put together to those of ``keys``; groups with a null in them don't count."""
    at = _complete(spans, keys)
    if keys == g:
        return at
    return at.groupBy(*keys, "field", "range").agg(F.sum("n").alias("n"), F.min("bottom").alias("bottom"), F.max("top").alias("top"))


def _complete(df: DataFrame, keys) -> DataFrame:
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)) if keys else df


def _centres(known, spans, levels, fields, name) -> list[DataFrame]:
    """Per level: ``keys, field, at`` with the prediction of each group, its median or the place of its most frequent value.

    Only counts by range cross the network for all rows; values do for the ranges the medians are in.
    """
    cats = [f for f, s in fields.items() if isinstance(s, Category)]
    out = []
    for keys, h in zip(levels, spans):
        own = Window.partitionBy(*keys, "field")  # at most RANGES rows a group
        h = h.withColumns({"upto": F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(own)})
        before = F.col("upto") - F.col("n")
        ranks = [F.floor((F.col("all") + k) / 2) for k in (1, 2)]  # the two rows in the middle; one row if their number is odd
        inside = [(before < r) & (r <= F.col("upto")) for r in ranks]
        want = h.where(~F.col("field").isin(*cats) & (inside[0] | inside[1])).select(*keys, "field", "range", *[F.when(x, r - before).alias(f"q{j}") for j, (x, r) in enumerate(zip(inside, ranks))])
        values = known.join(want, [*keys, "field", "range"]).groupBy(*keys, "field", "range", "q0", "q1", "at").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "field", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        values = values.withColumn("upto", upto)
        hit = [(F.col("upto") - F.col("n") < F.col(f"q{j}")) & (F.col(f"q{j}") <= F.col("upto")) for j in (0, 1)]
        mid = values.groupBy(*keys, "field").agg(*[F.max(F.when(x, F.col("at"))).alias(f"v{j}") for j, x in enumerate(hit)])
        centre = mid.select(*keys, "field", ((F.col("v0") + F.col("v1")) / 2).alias("at"))
        if cats:
            best = h.where(F.col("field").isin(*cats)).groupBy(*keys, "field").agg(F.max_by("top", F.struct("n", -F.col("range"))).alias("at"))
            centre = centre.unionByName(best)
        out.append(materialise(centre, f"{name}-centres"))
    return out


def _nearest(pool, spans, want, keys) -> DataFrame:
    """``keys, field, at, low, high``: for each place that is wanted the observed rows (at, id, v) next to it from below and above.

    ``pool`` are the observed rows (``keys, field, range, at, id, v``), ``spans`` the ends (``bottom, top``) of its ranges,
    ``want`` the places (``keys, field, range, at``), none twice. A row at the place itself is both; of rows at one place
    the smallest id counts. The ends tell which ranges hold the nearest rows: the place's own, and the next one that
    has rows where its own has none on that side. Only rows of those are compared, range by range, so the search is
    exact and no task gets more than a range of a group.
    """
    by = [*keys, "field", "range"]
    ends = spans.select(*by, "bottom", "top").unionByName(want.select(*by, F.col("at").alias("least"), F.col("at").alias("most")), allowMissingColumns=True)
    ends = ends.groupBy(*by).agg(*[f(c).alias(c) for f, c in ((F.min, "bottom"), (F.max, "top"), (F.min, "least"), (F.max, "most"))])
    side = Window.partitionBy(*keys, "field")  # as many rows as there are ranges
    has = F.when(F.col("bottom").isNotNull(), F.col("range"))
    none = F.col("bottom").isNull()
    before, after = (F.last(has, ignorenulls=True).over(side.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)) for o in (F.asc("range"), F.desc("range")))
    looks = ends.withColumns({"before": before, "after": after}).where("least IS NOT NULL")
    there = F.array(has, F.when(none | (F.col("least") < F.col("bottom")), F.col("before")), F.when(none | (F.col("most") > F.col("top")), F.col("after")))
    looks = looks.select(*keys, "field", F.col("range").alias("asked"), F.explode(there).alias("range")).where("range IS NOT NULL")
    looks = materialise(looks, "looks")  # read twice, and its size is known: while it is small no observed row is shuffled for it
    near = _complete(pool, keys).join(looks, by, "left_semi").groupBy(*by, "at").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))
    ask = want.withColumnRenamed("range", "asked").join(looks, [*keys, "field", "asked"]).select(*by, "at", F.lit(True).alias("wanted"))
    both = near.select(*by, "at", F.struct("at", "id", "v").alias("d")).unionByName(ask, allowMissingColumns=True)
    low, high = (F.last("d", ignorenulls=True).over(Window.partitionBy(*by).orderBy(o).rangeBetween(Window.unboundedPreceding, 0)) for o in (F.asc("at"), F.desc("at")))
    found = both.withColumns({"low": low, "high": high}).where("wanted")
    return found.groupBy(*keys, "field", "at").agg(F.max("low").alias("low"), F.min("high").alias("high"))


def _predictions(base, g, finest, matched, nums) -> DataFrame:
    """``base`` with ``f__p`` for each matched field: the finest group's median and what the covariate adds; null without a median."""
    medians = finest.groupBy(*g).agg(*[F.max(F.when(F.col("field") == f, F.col("at"))).alias(f"{f}__c") for f in matched])
    xs = sorted({nums[f].covariate for f in matched})
    means = base.groupBy(*g).agg(*[F.avg(x).alias(f"{x}__x") for x in xs])
    side = medians.join(means, g, "left") if g else medians.crossJoin(means)  # one row each
    rows = base.join(side, g, "left") if g else base.crossJoin(F.broadcast(side))
    rows = rows.crossJoin(F.broadcast(_slopes(base, g[:1], {f: nums[f] for f in matched})))  # one row
    add = lambda f: F.coalesce(F.col(f"{f}__b") * (F.col(nums[f].covariate) - F.col(f"{nums[f].covariate}__x")), F.lit(0.0))
    return rows.select(*base.columns, *[(F.col(f"{f}__c") + add(f)).alias(f"{f}__p") for f in matched])


def _slopes(base, coarse, matched) -> DataFrame:
    """One row: for each field the pooled within-group slope on its covariate (0 where undefined)."""
    sums, out = [], []
    for f, s in matched.items():
        x, both = s.covariate, F.col(f).isNotNull() & F.col(s.covariate).isNotNull()
        for tag, e in (("n", F.lit(1.0)), ("x", F.col(x)), ("y", F.col(f)), ("xx", F.col(x) * F.col(x)), ("xy", F.col(x) * F.col(f))):
            sums.append(F.sum(F.when(both, e)).alias(f"{f}__{tag}"))
        n, x, y, xx, xy = (F.col(f"{f}__{t}") for t in ("n", "x", "y", "xx", "xy"))
        below = F.sum(F.when(n > 0, xx - x * x / n))
        out.append(F.coalesce(F.when(below > 1e-9, F.sum(F.when(n > 0, xy - x * y / n)) / below), F.lit(0.0)).alias(f"{f}__b"))
    return base.groupBy(*coarse).agg(*sums).agg(*out)


def _step_of(c: Column, fields, steps: int) -> Column:
    out = F.lit(None).cast("int")
    for f, s in fields.items():
        out = F.when(F.col("field") == f, s.step(c, steps)).otherwise(out)
    return out


def _donors(own, missing, g, levels, matched, name) -> DataFrame:
    """``*g_d, level_d, field_d, at_d, d``: for each group, field and prediction that is wanted the donor (at, id, v) with the nearest prediction."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("v"), F.col(f"{f}__p").alias("at")) for f in matched]
    rows = own.select(F.col("__id").alias("id"), *g, F.explode(F.array(*parts)).alias("c")).select("id", *g, "c.*").where("v IS NOT NULL AND at IS NOT NULL")
    rows = rows.groupBy(*g, "field", "at").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))
    rows = materialise(rows.withColumn("range", _step_of(F.col("at"), matched, STEPS)), f"{name}-donors")
    out = None
    for keys in levels:
        n = len(keys)
        spans = _complete(rows, keys).groupBy(*keys, "field", "range").agg(*_ends())
        want = missing.where((F.col("level") == n) & F.col("own").isNotNull()).select(*keys, "field", F.col("own").alias("at")).distinct()
        near = _nearest(rows, spans, want.withColumn("range", _step_of(F.col("at"), matched, STEPS)), keys)
        step = {c: _step_of(F.col(c), matched, STEPS) for c in ("at", "low.at", "high.at")}
        far = [F.struct(F.abs(step["at"] - step[f"{d}.at"]), F.abs(F.col("at") - F.col(f"{d}.at"))) for d in ("low", "high")]
        nearer = F.when(F.col("low").isNotNull() & (F.col("high").isNull() | (far[0] <= far[1])), F.col("low")).otherwise(F.col("high"))
        slots = [(F.col(k) if k in keys else F.lit(None).cast(own.schema[k].dataType)).alias(f"{k}_d") for k in g]
        near = near.select(*slots, F.lit(n).alias("level_d"), F.col("field").alias("field_d"), F.col("at").alias("at_d"), nearer.alias("d"))
        out = near if out is None else out.unionByName(near)
    return out
