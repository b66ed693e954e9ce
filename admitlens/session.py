"""Session helpers: building a session for tests/bench, the shared scratch
folder, and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimension-side rows we are willing to ship to every executor.
DEFAULT_BROADCAST_ROWS = 100_000


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "admitlens") -> SparkSession:
    """Session for tests and the bench. Production code receives a session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured (local tests) do we pick our own folder.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            root = None
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        # A cluster must name a shared folder; only a local session picks one.
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="admitlens-ckpt-")
    spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/admitlens/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts the
    lineage and survives lost executors like a checkpoint, and later reads take only
    the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store_and_clean(df: DataFrame, name: str) -> DataFrame:
    """``store``, after which the shuffle files of ``df`` are removed at once: for a job
    in rounds, whose files would else stay until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return store(df, name)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def replace_folder(spark: SparkSession, path: str, rows: pa.Table) -> None:
    """Replace the folder at ``path`` by one with a parquet file of ``rows``, which the
    driver holds: written without a job, and seen only when it is whole."""
    sink = pa.BufferOutputStream()
    pq.write_table(rows, sink)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder, part, whole = path_of(path), path_of(f"{path}/_part"), path_of(f"{path}/part-0.parquet")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(folder, True)
    out = fs.create(part)
    try:
        out.write(bytearray(sink.getvalue()))
    finally:
        out.close()
    if not fs.rename(part, whole):
        raise OSError(f"{whole} was not written")


def bounded_rows(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows: counted, reading at most
    one row more. Plan estimates are no bounds, so they are not asked. Callers
    hand in frames that are cheap to read again (stored or plain scans)."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a checked size; otherwise leave the choice
    to the optimizer / AQE (sort-merge or shuffled hash join, or a broadcast
    decided at run time from real shuffle sizes)."""
    return F.broadcast(df) if bounded_rows(df, max_rows) else df


def shuffled(df: DataFrame) -> DataFrame:
    """Join ``df`` by a shuffle, never by a broadcast: for frames whose size the plan
    cannot know (Python steps that give many rows for one, checkpoints behind them).
    Estimates of those are too small, and the driver would hold what is broadcast."""
    return df.hint("merge")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table (read-only parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
