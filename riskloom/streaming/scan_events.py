"""Scan events as a stream: windows, running job statistics, adaptive rates.

Every operator is a function of a DataFrame that works on a batch and on a stream alike; ``run`` drives a stream
over what is there and returns when it is done.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path

KINDS = {"error": "target_error", "purchase": "target_complete", "view": "timeout", "click": "success", "signup": "job_start"}


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def scan_events(events: DataFrame) -> DataFrame:
    """Events in the form of a scan: kind, job, zone, duration."""
    kind = F.lit("other")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("user_id") % 10).alias("job"), (F.col("user_id") % 5).alias("zone"), F.col("value").alias("duration"))


def tumbling(ev: DataFrame, size: str = "1 hour", late: str = "10 hours") -> DataFrame:
    """Outcomes per tumbling window; windows older than ``late`` are closed and forgotten."""
    w = ev.withWatermark("ts", late).groupBy(F.window("ts", size))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "target_error").alias("errors"), F.count_if(F.col("kind") == "timeout").alias("timeouts")).select(F.col("window.start").alias("start"), "n", "errors", "timeouts")


def sliding(ev: DataFrame, size: str = "5 hours", step: str = "1 hour", late: str = "10 hours") -> DataFrame:
    w = ev.withWatermark("ts", late).groupBy(F.window("ts", size, step))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "target_error").alias("errors")).select(F.col("window.start").alias("start"), "n", "errors")


def job_progress(ev: DataFrame) -> DataFrame:
    """Running statistics per job: completed, failed, mean duration of those above 0."""
    done, bad = F.col("kind") == "target_complete", F.col("kind") == "target_error"
    return ev.groupBy("job").agg(F.count_if(done).alias("completed"), F.count_if(bad).alias("failed"), F.round(F.avg(F.when(done & (F.col("duration") > 0), F.col("duration"))), 6).alias("avg_duration"))


def job_zones(ev: DataFrame) -> DataFrame:
    return ev.where("kind IN ('target_complete', 'target_error')").groupBy("job", "zone").agg(F.count(F.lit(1)).alias("scanned"), F.round(F.sum("duration"), 4).alias("total"))


def job_zone_findings(ev: DataFrame) -> DataFrame:
    """Per job and zone: targets scanned, findings among them, mean criticality (1 to 5, from the event's number)."""
    done = ev.where("kind IN ('target_complete', 'target_error')")
    return done.groupBy("job", "zone").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("kind") == "target_error").alias("findings"), F.round(F.avg(F.col("event_id") % 5 + 1), 6).alias("avg_criticality"))


def sessions(ev: DataFrame, gap: str = "2 hours", late: str = "10 hours") -> DataFrame:
    w = ev.withWatermark("ts", late).groupBy("job", F.session_window("ts", gap))
    return w.agg(F.count(F.lit(1)).alias("n")).select("job", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def partial_counts(ev: DataFrame, size_s: int = 3600) -> DataFrame:
    """``job, t, n, e, o``: events, errors and timeouts per job and bucket, counted in each task before any shuffle.

    A stream can't aggregate twice without state, so the tasks put their own rows together in Arrow; what goes on is
    one row per job, bucket and task instead of one per event. The rows still have to be summed by job and bucket.
    """
    rows = ev.select("job", F.floor(F.unix_seconds("ts") / size_s).cast("bigint").alias("t"), F.when(F.col("kind") == "target_error", 1).otherwise(0).alias("e"), F.when(F.col("kind") == "timeout", 1).otherwise(0).alias("o"))

    def count(batches):
        held = None
        for batch in batches:
            some = pa.Table.from_batches([batch]).append_column("n", pa.repeat(pa.scalar(1, pa.int64()), batch.num_rows))
            some = some.set_column(2, "e", some["e"].cast(pa.int64())).set_column(3, "o", some["o"].cast(pa.int64()))
            held = some if held is None else pa.concat_tables([held.select(some.column_names), some])
            sums = held.group_by(["job", "t"]).aggregate([("e", "sum"), ("o", "sum"), ("n", "sum")])
            held = sums.rename_columns({"e_sum": "e", "o_sum": "o", "n_sum": "n"}).select(["job", "t", "e", "o", "n"])
        if held is not None:
            yield from held.select(["job", "t", "n", "e", "o"]).combine_chunks().to_batches()

    return rows.mapInArrow(count, "job bigint, t bigint, n bigint, e bigint, o bigint")


def adaptive_rate(ev: DataFrame, start: int = 20, low: int = 1, high: int = 100) -> DataFrame:
    """Per job and trigger the adaptive rate, kept in state between triggers; see ``operators.jobs.aimd``.

    Events are counted per job and hour in the tasks first, so a job with a third of all events sends a few rows per
    task. State per job is seven numbers: rate, last error, last change, and the open window's time and counts.
    Within a trigger windows are taken by time; across triggers by arrival, as a rate limiter sees them.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, err, adj, sec, n, e, o = state.get if state.exists else (start, -(10**9), -(10**9), -1, 0, 0, 0)
        sums: dict[int, list[int]] = {}
        for rows in batches:
            for t, *some in rows[["t", "n", "e", "o"]].groupby("t").sum().itertuples():
                sums[int(t)] = [int(x) + int(y) for x, y in zip(some, sums.get(int(t), (0, 0, 0)))]
        for t in sorted(sums):
            if t != sec:
                rate, err, adj = _close(rate, err, adj, sec, n, e, o, low, high)
                sec, n, e, o = t, 0, 0, 0
            n, e, o = n + sums[t][0], e + sums[t][1], o + sums[t][2]
        state.update((int(rate), int(err), int(adj), int(sec), int(n), int(e), int(o)))
        final = _close(rate, err, adj, sec, n, e, o, low, high)
        yield pd.DataFrame({"job": [key[0]], "rate": [int(final[0])]})

    return partial_counts(ev).groupBy("job").applyInPandasWithState(
        fold, "job bigint, rate int", "rate int, err bigint, adj bigint, sec bigint, n bigint, e bigint, o bigint", "update", GroupStateTimeout.NoTimeout
    )


def _close(rate, err, adj, t, n, e, o, low, high):
    if e:
        err = t
    if n >= 10:
        if e / n > 0.1 or o / n > 0.05:
            return max(low, int(rate * 0.5)), err, t
        if t - err > 5 and t - adj > 5:
            return min(high, rate + 2), err, t
    return rate, err, adj


def run(stream: DataFrame, mode: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Drive a stream over all that is there; its rows as a table.

    Every trigger's rows are written to the shared folder, where the checkpoint lies too: nothing is gathered in the
    driver, and a trigger that is run again overwrites its own files. In complete mode the last trigger's rows are the
    result, in append mode all rows, in update mode the latest row of each of ``keys``.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, f"stream-{name}")

    def write(rows: DataFrame, n: int) -> None:
        rows.withColumn("__trigger", F.lit(n).cast("bigint")).write.mode("overwrite").parquet(f"{path}/rows/trigger={n}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    if last is None:
        return spark.createDataFrame([], stream.schema)
    kind = StructType([*stream.schema.fields, StructField("__trigger", LongType())])
    rows = spark.read.schema(kind).parquet(f"{path}/rows/*")
    if mode == "complete":
        rows = rows.where(F.col("__trigger") == rows.agg(F.max("__trigger")).first()[0])
    elif mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max(F.struct("__trigger", *rest)).alias("__b"))
        return best.select(*[F.col(c) if c in keys else F.col("__b")[c].alias(c) for c in stream.columns])
    return rows.drop("__trigger")


def notify(stream: DataFrame, sink, checkpoint: str, mode: str = "update"):
    """Hand every trigger's rows to ``sink(df, batch_id)``: fan-out to subscribers, notifications, history."""
    return stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).start()


class Progress(StreamingQueryListener):
    """Calls ``told(name, trigger, rows)`` after every trigger: running progress for whoever registered it with
    ``spark.streams.addListener``."""

    def __init__(self, told):
        self.told = told

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.told(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of three triggers by event id (1, 2 and 0 modulo 3): all rows, most of the last ones late.

    Spark holds events against the watermark two triggers back, so the third delivery is the first that can be late.
    """
    path = scratch_path(spark, "deliveries")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    for n in (1, 2, 0):
        e.where(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
