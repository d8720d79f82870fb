"""Missing severity, cvss and epss of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .delivery import latest_delivery
from .impute import Category, Numeric, fill_missing

SEVERITY = Category(("critical", "high", "medium", "low"))
CVSS = (("low", 4.0), ("medium", 7.0), ("high", 9.0), ("critical", None))
EPSS = (("low", 0.1), ("medium", 0.5), ("high", None))
#: Predicted by the group alone, and with cvss and epss sharpening each other.
BY_GROUP = {"severity": SEVERITY, "cvss": Numeric(0.0, 10.0, None, CVSS), "epss": Numeric(0.0, 1.0, None, EPSS)}
BY_COVARIATE = {"severity": SEVERITY, "cvss": Numeric(0.0, 10.0, "epss", CVSS), "epss": Numeric(0.0, 1.0, "cvss", EPSS)}


def latest_findings(findings: DataFrame) -> DataFrame:
    month = F.date_format("observed_at", "yyyy-MM")
    return latest_delivery(findings, "finding_id", "ingested_at", {"misconfig_id": "misconfig_id", "month": month, "severity": "severity", "cvss": "cvss", "epss": "epss"})


def fill_findings(findings: DataFrame, fields=BY_COVARIATE, back_off: bool = True) -> DataFrame:
    """Every missing cell of the findings with its fill; see ``fill_missing``. Groups: misconfiguration, month."""
    return fill_missing(latest_findings(findings), "finding_id", ("misconfig_id", "month"), fields, "findings", back_off)


def masked_accuracy(findings: DataFrame, one_in: int = 10) -> DataFrame:
    """``field, cells, mean_error, spread``: how near the fills come to known cells that were hidden.

    A share of the known cells (by a hash of the id and the field) is hidden, filled from all others, and compared.
    ``mean_error`` is the mean distance of the fill (categories: 0 if right, else 1), ``spread`` the mean distance of
    the cells from their median (categories: the share that isn't the most frequent): what no grouping would give.
    """
    known = latest_findings(findings)
    known = known.select("finding_id", "misconfig_id", "month", *[s.known(F.col(f)).alias(f) for f, s in BY_COVARIATE.items()])
    hide = {f: F.pmod(F.xxhash64("finding_id", F.lit(f)), F.lit(one_in)) == 0 for f in BY_COVARIATE}
    masked = known.withColumns({f: F.when(~hide[f], F.col(f)) for f in BY_COVARIATE})
    fills = fill_missing(masked, "finding_id", ("misconfig_id", "month"), BY_COVARIATE, "masked").select("finding_id", "field", "filled")
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("hidden")) for f in BY_COVARIATE]
    truth = known.select("finding_id", F.explode(F.array(*parts)).alias("t")).select("finding_id", "t.*").where("hidden IS NOT NULL")
    both = materialise(truth.join(fills, ["finding_id", "field"]), "masked-pairs")
    text = F.col("field") == "severity"
    middle = both.groupBy("field").agg(F.expr("approx_percentile(try_cast(hidden AS double), 0.5)").alias("median"), F.mode("hidden").alias("mode"))
    off = F.when(text, (F.col("hidden") != F.col("filled")).cast("double")).otherwise(F.abs(F.col("hidden").try_cast("double") - F.col("filled").try_cast("double")))
    far = F.when(text, (F.col("hidden") != F.col("mode")).cast("double")).otherwise(F.abs(F.col("hidden").try_cast("double") - F.col("median")))
    return both.join(F.broadcast(middle), "field").groupBy("field").agg(  # one row a field
        F.count(F.lit(1)).alias("cells"), F.round(F.avg(off), 6).alias("mean_error"), F.round(F.avg(far), 6).alias("spread")
    )
