"""Free-typed values to the entries of a reference list.

Values are deduplicated, normalised, and looked up in an inverted index of character n-grams; the candidates are
scored by weighted cosine, the score is refined by an exact edit distance, and the best is accepted above a
threshold and a margin. Everything runs on distinct values inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

# Chosen by hand on typed values of sf0.01 whose meaning the asset's name gives away (test_every_form_maps_to_its_entry
# holds them to that); other data may want others.
THRESHOLD = 0.42
MARGIN = 0.01
FIRST_WORD = 1.5  # in compound names the first word tells more than the head noun
EDIT_SHARE = 0.3
NEAR = 0.1  # the exact check: at least this share of the characters must agree ('wwww...' holds all n-grams of 'www')

# Accented letters and the plain letters they stand for.
_ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįłľñńňòóôõöøōőřśšşșťțùúûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiillnnnoooooooorssssttuuuuuuuuyyzzz"
assert len(_ACCENTED) == len(_PLAIN)


def normalised(c: Column) -> Column:
    """Lower case without accents, remarks in brackets, '#7', '/ ...' and punctuation; digits inside words as letters."""
    s = F.translate(F.lower(c), _ACCENTED, _PLAIN)
    s = F.regexp_replace(s, r"\p{M}+", "")
    s = F.regexp_replace(s, r"\([^)]*\)|#\s*\d+|/.*$", " ")
    s = F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))
    words = F.transform(F.split(s, " "), lambda w: F.when(w.rlike(r"\p{L}"), F.translate(w, "0135", "oles")).otherwise(w))
    return F.array_join(words, " ")


def _slices(s: Column, n: int) -> Column:
    """All runs of ``n`` characters, in time linear in the length (the characters are split once, as ``cs``)."""
    places = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
    runs = F.flatten(F.transform(F.array(F.split(s, "")), lambda cs: F.transform(places, lambda i: F.concat(*[F.element_at(cs, i + k) for k in range(n)]))))
    return F.when(F.length(s) >= n, runs).otherwise(F.array().cast("array<string>"))


def _grams(s: Column) -> Column:
    """Distinct 2- and 3-grams of the words (with their ends marked) and of the whole without blanks."""
    marked = F.transform(F.split(s, " "), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    words = F.flatten(F.transform(marked, lambda w: F.concat(_slices(w, 2), _slices(w, 3))))
    joined = F.regexp_replace(s, " ", "")
    return F.array_distinct(F.concat(words, _slices(joined, 2), _slices(joined, 3)))


def reference_forms(ref: DataFrame) -> DataFrame:
    """``field_name, canonical, form``: the normalised ways to write each entry.

    Besides the canonical name, the display name and the aliases: mixes of both names word by word, where they
    have as many words (from 'prod-db' and 'Production Database' also 'prod database' and 'production db').
    """
    a, b = normalised(F.col("canonical")), normalised(F.col("display_name"))
    both = ref.select("field_name", "canonical", a.alias("a"), b.alias("b"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalised).alias("al"))
    x, y = F.split("a", " "), F.split("b", " ")
    mix = F.transform(
        F.sequence(F.lit(0), F.shiftleft(F.lit(1), 3) - 1),
        lambda m: F.array_join(F.zip_with(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), F.sequence(F.lit(0), F.size(x) - 1),
                                          lambda w, i: F.when(F.getbit(m, i) == 1, w["q"]).otherwise(w["p"])), " "),
    )
    mixes = F.when((F.size(x) == F.size(y)) & (F.size(x) <= 3), mix).otherwise(F.array().cast("array<string>"))
    forms = F.array_distinct(F.array_compact(F.concat(F.array("a", "b"), F.col("al"), mixes)))
    return both.select("field_name", "canonical", F.explode(forms).alias("form")).where("form <> ''").distinct()


def _sorted_words(s: Column) -> Column:
    return F.array_join(F.array_sort(F.split(s, " ")), "")


def map_values(values: DataFrame, ref: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """``field_name, value, n, canonical, score, lead``: the entry meant by each distinct value, null if none.

    ``values``: ``field_name, value``, one row per use (``n`` counts them, combined map-side); ``ref``:
    ``field_name, canonical, display_name, aliases``. Null and blank values come out without an entry, as do
    values of a field without reference entries. ``score`` is the best entry's, ``lead`` its distance to the next
    entry that comes near enough to matter; below ``threshold`` or ``margin`` (so in ties too) no entry is taken.
    Values of any length are scored whole. The work grows with distinct values: repeated ones cost one count.

    An entry can only be taken, or stand within ``margin`` of one taken, from a cosine ``low`` on. By Cauchy and
    Schwarz the commonest n-grams of a value, as long as their share of its squared weight is below ``low`` squared,
    can't bring an entry there alone. So the inverted index is asked for the rarer n-grams only, and the common
    ones are added for what can still reach ``low``: exact, and no common n-gram's list of entries is read out.
    """
    low = max(0.0, (threshold - margin) * (1 + EDIT_SHARE) - EDIT_SHARE)
    distinct = values.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    distinct = materialise(distinct.withColumn("norm", normalised(F.col("value"))), "values")
    forms = materialise(reference_forms(ref), "forms")
    total = forms.groupBy(F.col("field_name").alias("f")).agg(F.count(F.lit(1)).alias("forms"))
    posts = forms.select("field_name", "canonical", "form", F.explode(_grams(F.col("form"))).alias("gram"))
    weights = posts.groupBy("field_name", "gram").agg(F.count(F.lit(1)).alias("df")).join(total, F.col("field_name") == F.col("f"))
    weights = weights.select(F.col("field_name").alias("f"), F.col("gram").alias("g"), F.log1p(F.col("forms") / F.col("df")).alias("w"))
    index = posts.join(weights, (F.col("field_name") == F.col("f")) & (F.col("gram") == F.col("g"))).select("f", "g", "w", "canonical", "form")
    index = materialise(index, "index")
    norms = index.groupBy("f", "canonical", "form").agg(F.sum(F.col("w") * F.col("w")).alias("form_norm"))
    norms = norms.select(F.col("f").alias("f0"), F.col("canonical").alias("c0"), F.col("form").alias("form0"), "form_norm")

    keyed = distinct.where("norm IS NOT NULL AND norm <> ''").select("field_name", "norm").distinct()
    first = F.when(F.contains("norm", F.lit(" ")), _grams(F.substring_index("norm", " ", 1))).otherwise(F.array().cast("array<string>"))
    keyed = keyed.select("field_name", "norm", first.alias("first"), _grams(F.col("norm")).alias("all"))
    boosted = lambda c, b: F.transform(c, lambda g: F.struct(g.alias("gram"), F.lit(b).alias("b")))
    grams = keyed.select("field_name", "norm", F.explode(F.concat(boosted(F.col("first"), FIRST_WORD**2), boosted(F.array_except("all", "first"), 1.0))).alias("x"))
    unknown = total.select(F.col("f").alias("f0"), F.log1p("forms").alias("w0"))
    grams = grams.select("field_name", "norm", "x.*").join(unknown, F.col("field_name") == F.col("f0")).join(weights, (F.col("field_name") == F.col("f")) & (F.col("gram") == F.col("g")), "left")
    w = F.coalesce("w", "w0")
    own = Window.partitionBy("field_name", "norm")  # one value's n-grams
    grams = grams.select("field_name", "norm", "gram", "b", (w * w * F.col("b")).alias("m"), F.col("w").isNotNull().alias("known"))
    grams = grams.withColumns({"upto": F.sum("m").over(own.orderBy("m", "gram").rowsBetween(Window.unboundedPreceding, 0)), "value_norm": F.sum("m").over(own)})
    grams = grams.withColumn("rare", F.col("upto") > F.col("value_norm") * (low * low * 0.999999))
    grams = grams.withColumn("rest", F.coalesce(F.max(F.when(~F.col("rare"), F.col("upto"))).over(own), F.lit(0.0))).where("known")
    grams = materialise(grams, "value-grams")

    part = grams.where("rare").join(index, (F.col("field_name") == F.col("f")) & (F.col("gram") == F.col("g")))
    sums = [F.sum("m").alias("dot"), F.sum(F.col("m") * (1 - 1 / F.col("b"))).alias("extra")]
    part = part.groupBy("field_name", "norm", "canonical", "form").agg(*sums, F.max("value_norm").alias("value_norm"), F.max("rest").alias("rest"))
    part = part.join(norms, (F.col("field_name") == F.col("f0")) & (F.col("canonical") == F.col("c0")) & (F.col("form") == F.col("form0"))).drop("f0", "c0", "form0")
    part = part.where(F.col("dot") + F.col("rest") >= (low - 1e-9) * F.sqrt(F.col("value_norm") * (F.col("form_norm") + F.col("extra"))))
    part = materialise(part, "reached")
    common = grams.where("NOT rare").select("field_name", "norm", "gram", "b", "m").join(part.select("field_name", "norm", "canonical", "form"), ["field_name", "norm"])
    common = common.join(index.select(F.col("f").alias("field_name"), F.col("g").alias("gram"), "canonical", "form"), ["field_name", "gram", "canonical", "form"])
    common = common.groupBy("field_name", "norm", "canonical", "form").agg(*[x.alias(n) for x, n in zip(sums, ("dot2", "extra2"))])
    scored = part.join(common, ["field_name", "norm", "canonical", "form"], "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0.0))
    cosine = add("dot", "dot2") / F.sqrt(F.col("value_norm") * (F.col("form_norm") + add("extra", "extra2")))
    s, t = F.regexp_replace("norm", " ", ""), F.regexp_replace("form", " ", "")
    edits = F.least(F.levenshtein(s, t), F.levenshtein(_sorted_words(F.col("norm")), _sorted_words(F.col("form"))))
    near = 1 - edits / F.greatest(F.length(s), F.length(t))
    score = (cosine + EDIT_SHARE * near) / (1 + EDIT_SHARE)
    per = scored.where((cosine >= low) & (near >= NEAR)).select("field_name", "norm", "canonical", F.round(score, 9).alias("score"))
    per = per.groupBy("field_name", "norm", "canonical").agg(F.max("score").alias("score"))
    place = F.row_number().over(own.orderBy(F.desc("score"), F.desc("canonical")))
    two = per.withColumn("r", place).where(F.col("r") <= 2)
    best = two.groupBy(F.col("field_name").alias("tf"), F.col("norm").alias("tn")).agg(
        F.max(F.when(F.col("r") == 1, F.col("canonical"))).alias("c"), F.max("score").alias("score"), (F.max("score") - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0))).alias("lead")
    )
    out = distinct.join(best, (F.col("field_name") == F.col("tf")) & (F.col("norm") == F.col("tn")), "left")
    taken = (F.col("score") >= threshold) & (F.col("lead") >= margin)
    return out.select("field_name", "value", "n", F.when(taken, F.col("c")).alias("canonical"), "score", "lead")


def map_columns(df: DataFrame, key: str, columns: list[str], ref: DataFrame) -> DataFrame:
    """``key, field_name, value, canonical``: for every row and column whose value is no canonical entry itself.

    ``canonical`` is null where no entry is meant. Rows must be unique by ``key``. The typed values join their
    mapping by value, so a value typed in a third of all rows is a skewed equi-join that AQE splits.
    """
    exact = ref.select(F.col("field_name").alias("rf"), F.col("canonical").alias("rc")).where("rc IS NOT NULL").distinct()
    parts = [F.struct(F.lit(c).alias("field_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"), F.col(c).isNull().alias("gone")) for c in columns]
    long = df.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*")
    typed = long.join(exact, (F.col("field_name") == F.col("rf")) & (F.col("value") == F.col("rc")), "left_anti")
    typed = materialise(typed, "typed")
    mapping = map_values(typed.select("field_name", "value"), ref).select(F.col("field_name").alias("mf"), F.col("value").alias("mv"), "canonical")
    out = typed.join(mapping, (F.col("field_name") == F.col("mf")) & (F.col("value") == F.col("mv")), "left")
    return out.select(key, "field_name", F.when(~F.col("gone"), F.col("value")).alias("value"), "canonical")
