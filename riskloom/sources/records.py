"""Readers and writers: requests, job files, collector output, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = (
    "environment struct<assets:array<struct<id:string,name:string,type:string,ip:string,zone:string,criticality:int,internet_facing:boolean,domain_joined:boolean,"
    "services:array<string>,data_sensitivity:string,misconfigurations:array<struct<id:string,title:string,description:string,category:string,severity:string,cvss:double,epss:double,exploit_available:boolean>>>>>, maxPaths int"
)
JOB = "id string, type string, status string, priority string, progress double, createdAt bigint, startTime bigint, endTime bigint, createdBy string, error string"


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Asset requests, one JSON document per file, by an explicit schema; one row per asset.

    Documents without assets give no rows; malformed ones neither (they come out of ``rejected_requests``).
    """
    docs = spark.read.schema(REQUEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = docs.select(F.coalesce("maxPaths", F.lit(10)).alias("max_paths"), F.explode("environment.assets").alias("a"))
    return rows.select("max_paths", "a.*").where("id IS NOT NULL")


def rejected_requests(spark: SparkSession, path: str) -> DataFrame:
    """``file, reason`` of requests that hold no assets."""
    docs = spark.read.schema(REQUEST).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.size("environment.assets").alias("n"))
    return docs.where("n IS NULL OR n <= 0").select("file", F.lit("no assets").alias("reason"))


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job files (one JSON document each) with their times as timestamps."""
    at = lambda c: F.timestamp_millis(F.col(c))
    df = spark.read.schema(JOB).option("multiLine", True).json(path)
    return df.select("id", "type", "status", "priority", "progress", at("createdAt").alias("created_at"), at("startTime").alias("started_at"), at("endTime").alias("ended_at"), "createdBy", "error")


def write_jobs(df: DataFrame, path: str, append: bool = False) -> None:
    """Jobs as JSON lines; ``append`` keeps a history."""
    df.write.mode("append" if append else "overwrite").json(path)


def parse_collected(output: Column, marker: str = "###GROUP:", failed: str = "CMD_FAILED") -> Column:
    """A collector's output, cut at 'marker name' lines, as a map 'name_0' -> text of the part.

    Parts whose text says that the command failed are left out here; ``failed_parts`` names them.
    """
    return F.map_from_entries(F.filter(_parts(output, marker), lambda e: ~F.contains(e["value"], F.lit(failed))))


def failed_parts(output: Column, marker: str = "###GROUP:", failed: str = "CMD_FAILED") -> Column:
    return F.transform(F.filter(_parts(output, marker), lambda e: F.contains(e["value"], F.lit(failed))), lambda e: e["key"])


def _parts(output: Column, marker: str) -> Column:
    cut = F.slice(F.split(output, "(?m)^" + marker + " *"), 2, 1_000_000)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    named = F.transform(cut, lambda p: F.struct(trim(F.substring_index(p, "\n", 1)).alias("name"), trim(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("value")))
    return F.transform(named, lambda e, i: F.struct(F.concat_ws("_", e["name"], i.cast("string")).alias("key"), e["value"].alias("value")))


def content_key(*columns: Column) -> Column:
    """A content-derived key: the SHA-256 of the parts."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def notifications(events: DataFrame, channels: str = "channels", only: tuple[str, ...] = ()) -> DataFrame:
    """One row per event and channel (of ``only``, if named); events without channels notify nobody."""
    rows = events.withColumn("channel", F.explode(channels)).drop(channels)
    return rows.where(F.col("channel").isin(*only)) if only else rows


def stars(c: Column, most: int = 5) -> Column:
    """Full and empty stars for a share between 0 and 1."""
    n = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * most).cast("int")
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(most) - n))


def report_lines(df: DataFrame, label: str, share: str, width: int = 30) -> DataFrame:
    """``line``: a console report, one line a row: padded label, bar, percent."""
    text = F.concat(F.rpad(F.left(label, F.lit(width)), width, " "), F.lit(" "), bar(F.col(share)), F.lit(" "), F.lpad(F.format_string("%.1f%%", F.col(share) * 100), 6, " "))
    return df.select(text.alias("line"))


def bar(c: Column, width: int = 20) -> Column:
    """A console bar for a share between 0 and 1."""
    return F.rpad(F.repeat(F.lit("█"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * width).cast("int")), width, "░")


def without_fences(c: Column) -> Column:
    """A text without the code fences a language model may put around its answer."""
    return F.trim(F.regexp_replace(c, r"(?m)^\s*```[A-Za-z]*\s*$", ""))


def first_json(c: Column, schema: str, kind: str = "object") -> Column:
    """The first JSON object (or 'array') in a text, read by a schema; null where there is none or it doesn't fit.

    From the first opening bracket to the last closing one, fences apart.
    """
    block = F.regexp_extract(without_fences(c), r"(?s)\{.*\}" if kind == "object" else r"(?s)\[.*\]", 0)
    return F.from_json(F.nullif(block, F.lit("")), schema, {"mode": "PERMISSIVE"})


def _absent(m: Column):
    return lambda k, _: ~F.map_contains_key(m, k)


def merged(*maps: Column) -> Column:
    """Several maps as one; of equal keys the last map's value counts, null maps are empty."""
    out = None
    for m in maps:
        m = F.coalesce(m, F.create_map().cast("map<string,string>"))
        if out is None:
            out = m
        else:
            out = F.map_concat(F.map_filter(out, _absent(m)), m)
    return out
