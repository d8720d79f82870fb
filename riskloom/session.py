"""Session set-up, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "assets findings attack_paths scan_jobs analysis_records eval_items canon_ref misconfig_catalog"
).split()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where it isn't set, a local session gets a temporary folder of its own; on a cluster that is an error, for
    files on one machine's disk would be lost to all others.
    """
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if have:
        return have
    if not _one_process(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="riskloom-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def _one_process(master: str) -> bool:
    """Whether driver and executors are one process: 'local' and 'local[...]', but not 'local-cluster[...]'."""
    return master == "local" or master.startswith("local[")


_written: dict[str, list[str]] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later stages depend on files every executor can read, so a lost executor costs a
    re-read, not a re-run. Unlike ``checkpoint()`` the rows are stored once, columnar and compressed. The files
    stay until ``release`` or the end of the ``scratch`` block they were written in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by ``release`` or at the end of the ``scratch`` block."""
    path = os.path.join(shared_dir(spark), f"riskloom-{name}-{uuid.uuid4().hex[:12]}")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete everything ``materialise`` wrote for this application; call once no result is needed any more."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))


@contextmanager
def scratch(spark: SparkSession):
    """``with scratch(spark): query(...).write...`` deletes what was materialised inside, once the result is written."""
    mine = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(mine)
    try:
        yield
    finally:
        paths, mine[before:] = mine[before:], []
        _delete(spark, paths)
