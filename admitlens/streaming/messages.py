"""The message log and its streaming source, whose offset is the message number.

A log is a folder of numbered messages: ``first=<number>`` folders of at most
``BLOCK`` messages each, numbered from 0 without gaps. The source reads them by
number: a batch holds the next ``pace`` messages, however they lie in files, and a
restarted stream goes on behind the last number of its checkpoint. Messages in a
folder whose predecessors are not all there yet are not seen yet."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from admitlens.operators.numbering import with_row_index
from admitlens.session import store

BLOCK = 10_000           # messages of a folder
READ = 1_000, 20_000     # messages of a reading task, least and most
TASKS = 4                # reading tasks of a batch, where these allow it
FORMAT = "message_log"


def append_messages(df: DataFrame, path: str, order: list[Column | str], value_col: str = "value") -> int:
    """Number the messages of ``df`` in ``order`` behind those of the log and write
    them; returns how many the log holds then. One writer at a time."""
    spark = df.sparkSession
    start = log_length(path)
    numbered = store(with_row_index(df.select(F.col(value_col).alias("value"), *[
        (F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)]),
        [f"o{i}" for i in range(len(order))], start, "number").select("number", "value"), "messages")
    first = F.lit(start) + F.floor((F.col("number") - start) / BLOCK) * BLOCK
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (numbered.withColumn("first", first).repartition(parts, "first").sortWithinPartitions("first", "number")
     .write.mode("append").partitionBy("first").parquet(path))
    return start + numbered.count()


Block = tuple[int, int, str]         # first message, end, folder


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _blocks(path: str, known: list[Block] | None = None) -> list[Block]:
    """Folders without a gap before them. Those ``known`` are not opened again: a folder
    does not change once it is there."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = _opened(path)
    out = list(known or [])
    end = out[-1][1] if out else 0
    found = []
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.Directory and info.base_name.startswith("first="):
            first = int(info.base_name.removeprefix("first="))
            if first >= end:
                found.append((first, info.path))
    for first, folder in sorted(found):
        rows = ds.dataset(folder, filesystem=system, format="parquet").count_rows() if first == end else 0
        if not rows:
            break
        end = first + rows
        out.append((first, end, folder))
    return out


def log_length(path: str) -> int:
    """Messages that the log at ``path`` holds."""
    blocks = _blocks(path)
    return blocks[-1][1] if blocks else 0


class _Range(InputPartition):
    """Messages of a reading task and the folders that hold them."""

    def __init__(self, start: int, end: int, folders: list[str]):
        self.start, self.end, self.folders = start, end, folders


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, pace: int):
        self.path, self.pace = path, pace
        self.at: int | None = None           # the number up to which batches are planned
        self.blocks: list[Block] = []        # folders seen, which only become more

    def _seen_to(self, number: int) -> int:
        """How far the log reaches; it is listed only if ``number`` lies behind that."""
        if not self.blocks or self.blocks[-1][1] < number:
            self.blocks = _blocks(self.path, self.blocks)
        return self.blocks[-1][1] if self.blocks else 0

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        at = self.at or 0
        self.at = max(at, min(at + self.pace, self._seen_to(at + self.pace)))
        return {"number": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:                  # a restart plans its last batch first
            self.at = end["number"]
        self._seen_to(end["number"])
        firsts = [first for first, _, _ in self.blocks]
        out = []
        step = min(max(READ[0], -(-(end["number"] - start["number"]) // TASKS)), READ[1])
        for i in range(start["number"], end["number"], step):
            j = min(i + step, end["number"])
            some = self.blocks[max(bisect_right(firsts, i) - 1, 0):bisect_left(firsts, j)]
            out.append(_Range(i, j, [folder for _, _, folder in some]))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        import pyarrow.dataset as ds

        system, _ = _opened(self.path)
        for folder in partition.folders:
            n = ds.field("number")
            rows = ds.dataset(folder, filesystem=system, format="parquet").to_table(
                columns=["number", "value"], filter=(n >= partition.start) & (n < partition.end)).sort_by("number")
            for batch in rows.to_batches(max_chunksize=1000):
                yield from zip(*(c.to_pylist() for c in batch.columns))


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").option("pace", n).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "number long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"].rstrip("/"), int(self.options.get("pace", "1")))


def read_message_stream(spark: SparkSession, path: str, pace: int = 1) -> DataFrame:
    """The log's messages (number, value) as a stream of ``pace`` messages a batch."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format(FORMAT).option("pace", str(pace)).load(path)
