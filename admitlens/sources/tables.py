"""The applicants table (path-based parquet, by batch and term year), its
rejects side table, and the watermark table.

Spark does not enforce keys; uniqueness of ``p_id`` comes from the load
(dedupe within the batch + anti join against the table) with a single writer
per table. A batch's rows, rejects and watermarks are staged in folders of their
own, under the batch's id, and count once the batch's commit marker exists: one
empty file, made in one step. What a failed batch has left is never read, and is
replaced when the batch comes again. Nothing reads and overwrites the same path.

Beside a batch's rows stand statistics of its files: the range of the keys and a
Bloom filter, by which a load reads only files that may hold its keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.schema import APPLICANT_COLUMNS, APPLICANTS, WATERMARKS

PARTITION_COL = "term_year"
BATCH_COL = "batch"
KEY = "p_id"
BITS_PER_KEY = 12
HASHES = 4
MOST_WORDS = 1 << 17     # 64-bit words of a file's filter (1 MB): larger files get more false positives


class CommitLog:
    """The batches that count: one empty marker file each, named by the id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _fs(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jpath

    def has(self, batch_id: str) -> bool:
        fs, path = self._fs(f"{self.path}/{quote(batch_id, safe='')}")
        return fs.exists(path)

    def ids(self) -> list[str]:
        fs, path = self._fs(self.path)
        return sorted(unquote(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def add(self, batch_id: str) -> None:
        fs, path = self._fs(f"{self.path}/{quote(batch_id, safe='')}")
        fs.mkdirs(path.getParent())
        fs.createNewFile(path)       # one step; a marker that is there stays

    def delete(self, path: str) -> None:
        fs, jpath = self._fs(path)
        if fs.exists(jpath):
            fs.delete(jpath, True)

    def exists(self, path: str) -> bool:
        fs, jpath = self._fs(path)
        return fs.exists(jpath)


def _with_partition(df: DataFrame) -> DataFrame:
    year = F.regexp_extract(F.coalesce(F.col("semester"), F.lit("")), r"(\d{4})", 1)
    return df.withColumn(PARTITION_COL, F.when(year != "", year.cast("int")))


# --- statistics of files -------------------------------------------------------

def _places(key: Column) -> list[Column]:
    """Hashes of a key, of which the filter's places are taken."""
    return [F.xxhash64(F.lit(i), key.cast("long")) for i in range(HASHES)]


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, word, bits) that the keys of a task set in their files' filters: a row for
    every word of a filter, not one per key and hash."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        files = batch.column(0).dictionary_encode()
        which = files.indices.to_numpy(zero_copy_only=False)
        sizes = batch.column(1).to_numpy()
        hashes = [c.to_numpy() for c in batch.columns[2:]]
        for i, file in enumerate(files.dictionary.to_pylist()):
            mine = which == i
            places = int(sizes[mine.argmax()]) * 64
            bits = held.setdefault(file, np.zeros(places, dtype=bool))
            for h in hashes:
                bits[np.mod(h[mine], places)] = True
    for file, bits in held.items():
        words = np.packbits(bits, bitorder="little").view("<i8")
        for a in range(0, len(words), 10_000):
            some = words[a:a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array(np.arange(a, a + len(some)), pa.int32()), pa.array(some, pa.int64())],
                                             names=["file", "word", "bits"])


def file_statistics(rows: DataFrame, key: str = KEY) -> DataFrame:
    """(file, low, high, words): per file of ``rows`` the range of its keys and a
    Bloom filter in 64-bit words. Each task makes its part of the filters of the files it
    reads (12 bytes a key), which are joined by word."""
    keys = rows.where(F.col(key).isNotNull()).select(F.col("_metadata.file_path").alias("file"), F.col(key).cast("long").alias("k"))
    sizes = keys.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("size", F.least(F.lit(MOST_WORDS), F.floor(F.col("n") * BITS_PER_KEY / 64) + 1))
    hashed = keys.join(F.broadcast(sizes.select("file", "size")), "file").select(
        "file", "size", *[h.alias(f"h{i}") for i, h in enumerate(_places(F.col("k")))])
    bits = hashed.mapInArrow(_filter_words, "file string, word int, bits long")
    # All words are there, so they need sorting alone: looking each up in a map would
    # take the square of a file's words.
    words = bits.groupBy("file", "word").agg(F.bit_or("bits").alias("bits")).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words"))
    return sizes.join(words, "file").select("file", "low", "high", "words")


def files_that_may_hold(statistics: DataFrame, hashes: np.ndarray, values: np.ndarray) -> DataFrame:
    """Files of ``statistics`` whose range and filter let one of the keys in.
    ``hashes`` has a row per key: its hashes; ``values`` the keys, ascending."""
    held = statistics.sparkSession.sparkContext.broadcast((hashes, values))

    @F.pandas_udf("boolean")
    def may_hold(low: pd.Series, high: pd.Series, words: pd.Series) -> pd.Series:
        hashes, values = held.value
        out = []
        for a, b, w in zip(low, high, words):
            i, j = np.searchsorted(values, a), np.searchsorted(values, b, side="right")
            w = np.asarray(w, dtype=np.int64)
            place = np.mod(hashes[i:j], len(w) * 64)
            out.append(bool(((w[place >> 6] >> (place & 63)) & 1).all(axis=1).any()))
        return pd.Series(out, dtype="bool")

    return statistics.where(may_hold("low", "high", "words")).select("file")


# --- tables --------------------------------------------------------------------

class Staged:
    """What one batch adds to a table: rows, rejects and watermarks, unseen until
    ``commit``; ``roll_back`` removes it."""

    def __init__(self, table: "ApplicantsTable", batch_id: str):
        self.table, self.batch_id = table, batch_id
        self.done = table.commits.has(batch_id)      # an earlier run has committed it
        self._paths: list[str] = []

    def _path(self, root: str) -> str:
        self._paths.append(f"{root}/{BATCH_COL}={quote(self.batch_id, safe='')}")
        return self._paths[-1]

    def rows(self, df: DataFrame) -> None:
        if self.done:
            return
        # Rebalanced by partition: few files per year, a hot year still splits.
        path = self._path(self.table.path)
        (_with_partition(df.select(*APPLICANT_COLUMNS)).hint("rebalance", PARTITION_COL)
         .write.mode("overwrite").partitionBy(PARTITION_COL).parquet(path))
        schema = T.StructType(APPLICANTS.fields + [T.StructField(PARTITION_COL, T.IntegerType())])
        written = self.table.spark.read.schema(schema).parquet(path)
        file_statistics(written).write.mode("overwrite").parquet(self._path(self.table.keys_path))

    def rejects(self, df: DataFrame) -> None:
        if not self.done:
            df.write.mode("overwrite").parquet(self._path(self.table.rejects_path))

    def watermarks(self, table: "WatermarkTable", df: DataFrame) -> None:
        if not self.done:
            df.select(*WATERMARKS.names).write.mode("overwrite").parquet(self._path(table.path))

    def commit(self) -> None:
        self.table.commits.add(self.batch_id)

    def roll_back(self) -> None:
        if not self.done:
            for path in self._paths:
                self.table.commits.delete(path)


class ApplicantsTable:
    """create-if-absent / scan / append / drop for the applicants table."""

    schema = T.StructType(APPLICANTS.fields + [T.StructField(BATCH_COL, T.StringType()),
                                               T.StructField(PARTITION_COL, T.IntegerType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.rejects_path = self.path + "_rejects"
        self.keys_path = self.path + "_keys"
        self.cells_path = self.path + "_cells"
        self.commits = CommitLog(spark, self.path + "_commits")

    def exists(self) -> bool:
        return self.commits.exists(self.path)

    def ensure(self) -> "ApplicantsTable":
        """CREATE TABLE IF NOT EXISTS: an empty folder."""
        fs, path = self.commits._fs(self.path)
        fs.mkdirs(path)
        return self

    def _read(self, root: str, schema: T.StructType | str | None, batch_ids: list[str] | None = None) -> DataFrame | None:
        """What committed batches have under ``root``; None where there is none. Their
        folders alone are listed."""
        ids = [i for i in self.commits.ids() if batch_ids is None or i in set(batch_ids)]
        folders = [f"{root}/{BATCH_COL}={quote(i, safe='')}" for i in ids]
        if root != self.path:                       # a batch may be without rejects
            folders = [f for f in folders if self.commits.exists(f)]
        if not folders:
            return None
        reader = self.spark.read.option("basePath", root)
        return (reader.schema(schema) if schema is not None else reader).parquet(*folders)

    def scan(self, with_partition: bool = False) -> DataFrame:
        """The table's rows. ``with_partition`` keeps ``term_year`` so that the
        questions can prune partitions for an exact term."""
        self.ensure()
        df = self._read(self.path, self.schema)
        df = self.spark.createDataFrame([], self.schema) if df is None else df
        return df.select(*APPLICANT_COLUMNS, *([PARTITION_COL] if with_partition else []))

    def scan_batches(self, batch_ids: list[str]) -> DataFrame:
        """Rows of some committed batches alone, with their batch."""
        df = self._read(self.path, self.schema, batch_ids)
        df = self.spark.createDataFrame([], self.schema) if df is None else df
        return df.select(*APPLICANT_COLUMNS, BATCH_COL)

    def key_files(self, keys: DataFrame, max_keys: int) -> list[str] | None:
        """Committed files that may hold one of the ``keys`` (one long column); None
        where there are more than ``max_keys`` keys."""
        name = keys.columns[0]
        k = F.col(name).cast("long")
        rows = keys.where(k.isNotNull()).select(k.alias("k"), *[h.alias(f"h{i}") for i, h in enumerate(_places(k))]).distinct()
        found = rows.limit(max_keys + 1).toPandas()
        if len(found) > max_keys:
            return None
        stats = self._read(self.keys_path, "file string, low long, high long, words array<long>, batch string")
        if not len(found) or stats is None:
            return []
        found = found.sort_values("k")
        hashes = found[[f"h{i}" for i in range(HASHES)]].to_numpy()
        return sorted(r["file"] for r in files_that_may_hold(stats, hashes, found["k"].to_numpy()).collect())

    def scan_for_keys(self, keys: DataFrame, max_keys: int) -> DataFrame:
        """Rows of the files that may hold one of the keys: all rows with those keys
        are among them, with others (range and filter let them in by chance)."""
        files = self.key_files(keys, max_keys)
        if files is None:
            return self.scan()
        if not files:
            return self.spark.createDataFrame([], APPLICANTS)
        read = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*files)
        return read.select(*APPLICANT_COLUMNS)

    def cells_folder(self, batch_id: str) -> str:
        """Where a batch's partial aggregates of the questions are kept."""
        return f"{self.cells_path}/{BATCH_COL}={quote(batch_id, safe='')}"

    def cells(self) -> DataFrame | None:
        """Partial aggregates of the committed batches; None without any."""
        return self._read(self.cells_path, None)

    def stage(self, batch_id: str) -> Staged:
        return Staged(self.ensure(), batch_id)

    def append(self, df: DataFrame, batch_id: str | None = None) -> None:
        """Stage and commit rows as one batch."""
        staged = self.stage(batch_id or uuid.uuid4().hex)
        staged.rows(df)
        staged.commit()

    def rejects(self) -> DataFrame:
        """Rejects of the committed batches."""
        df = self._read(self.rejects_path, None)
        return self.spark.createDataFrame([], "reject_reason string") if df is None else df.drop(BATCH_COL)

    def drop(self) -> None:
        """DROP TABLE IF EXISTS (removes the folders through the Hadoop FS), markers
        first: a table half removed has no rows."""
        for path in (self.commits.path, self.path, self.keys_path, self.cells_path):
            self.commits.delete(path)


class WatermarkTable:
    """One row per source: last value seen and when (parquet, append-only;
    the current watermark is the latest row per source). With ``commits``, those of
    a table, only rows of its committed batches count."""

    def __init__(self, spark: SparkSession, path: str, commits: CommitLog | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.commits = commits

    def scan(self) -> DataFrame:
        schema = T.StructType(WATERMARKS.fields + [T.StructField(BATCH_COL, T.StringType())])
        try:
            df = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":     # absent table = no watermarks
                raise
            return self.spark.createDataFrame([], WATERMARKS)
        if self.commits is not None:
            df = df.where(F.col(BATCH_COL).isin(self.commits.ids()))
        return df.select(*WATERMARKS.names)

    def append(self, df: DataFrame) -> None:
        batch_id = uuid.uuid4().hex
        df.select(*WATERMARKS.names).write.parquet(f"{self.path}/{BATCH_COL}={batch_id}")
        if self.commits is not None:
            self.commits.add(batch_id)
