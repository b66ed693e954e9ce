"""The task stream.

Task messages are JSON objects ``{"kind", "ts", "payload"}``: lines of text files, or
numbered messages of a log (``messages``; a broker connector plugs in the same way).
A Structured Streaming query decodes them, splits off malformed ones, hands the
others to their handlers inside ``foreachBatch`` and writes dead letters with their
reason in the same batch. Messages are handled in order: neighbours of one kind form
a run and one handler call. A run that fails is halved, and its halves handled in
order, until the messages that fail stand alone and go to the dead letters (never
retried), like a nack without requeue; so a handler must leave nothing behind when it
fails (see ``handlers``). The checkpoint plays the role of the ack: a batch is
committed only after its handlers returned. How many messages are in flight is the
stream's pace.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from admitlens.functions.text import CORRUPT, json_object
from admitlens.session import replace_folder
from admitlens.streaming.messages import read_message_stream

Handler = Callable[[DataFrame, int], None]

DECODED_COLUMNS = ["value", "status", "kind", "ts", "payload"]
HELD_MESSAGES = 20_000   # most messages of a batch that the driver holds
HELD_LENGTH = 2_000      # most characters of each


def iso_ts(ts: Column) -> Column:
    """datetime.isoformat(): microseconds only when non-zero."""
    micro = F.date_format(ts, "SSSSSS")
    return F.when(micro == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def task_message(kind: Column, ts: Column, payload_json: Column | None = None) -> Column:
    """T1 as a column: compact JSON ``{"kind", "ts", "payload"}``; a missing
    payload becomes {}."""
    payload = F.lit("{}") if payload_json is None else F.coalesce(payload_json, F.lit("{}"))
    body = F.struct(kind.alias("kind"), iso_ts(ts).alias("ts"),
                    F.parse_json(payload).alias("payload"))
    return F.to_json(body)


def encode_tasks(df: DataFrame, kind: Column | str, ts: Column | str,
                 payload_json: Column | str | None = None) -> DataFrame:
    """One compact JSON message per row."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x

    p = None if payload_json is None else c(payload_json)
    return df.select(task_message(c(kind), c(ts), p).alias("value"))


def _decoding(value_col: str = "value") -> tuple[Column, dict[str, Column]]:
    """T2 as columns: a message read, and from that, as ``_read``, what it holds."""
    read = json_object(F.col(value_col), "kind string, ts string, payload string").alias("_read")
    ok = F.col(f"_read.{CORRUPT}").isNull()
    return read, {
        "value": F.col(value_col), "status": F.when(ok, F.lit("ok")).otherwise(F.lit("malformed")),
        "kind": F.when(ok, F.coalesce("_read.kind", F.lit(""))), "ts": F.when(ok, F.col("_read.ts")),
        "payload": F.when(ok, F.coalesce("_read.payload", F.lit("{}")))}


def decode_tasks(messages: DataFrame, value_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Parse each message; ``status`` is 'ok' for a JSON object and
    'malformed' for bad JSON or JSON that is not an object. A missing kind
    reads as ''; a missing payload as {}; of equal keys the last counts."""
    read, cells = _decoding(value_col)
    return messages.withColumn("_read", read).select(*[c.alias(name) for name, c in cells.items()], *(keep or []))


def _route(status: Column, kind: Column, kinds: list[str]) -> Column:
    return F.when(status == "malformed", F.lit("malformed")).when(kind.isin(*kinds), kind).otherwise(F.lit("unknown_kind"))


def route_tasks(decoded: DataFrame, kinds: list[str]) -> DataFrame:
    """T3 (routing half): ``route`` = the kind when a handler exists, else the
    dead-letter reason ('malformed' / 'unknown_kind')."""
    return decoded.withColumn("route", _route(F.col("status"), F.col("kind"), kinds))


def dead_letter_frame(df: DataFrame, reason: Column | str, batch_id: int) -> DataFrame:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("value", r.alias("reason"), F.lit(batch_id).cast("long").alias("batch_id"))


PLACE = "_place"


def message_runs(routed: DataFrame, kinds: list[str]) -> list[tuple[str, int, int, int]]:
    """(kind, first place, last place, messages) of the runs of equal kinds, in order
    of place; messages without a handler interrupt none. Each task tells the runs it
    holds, a row each, and they are joined up; where tasks hold messages in between
    each other's, places and kinds are dealt out by place first."""
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            run = (f["route"] != f["route"].shift()).cumsum()
            yield f.groupby(run, sort=False).agg(kind=("route", "first"), first=(PLACE, "min"), last=(PLACE, "max"), n=(PLACE, "size"))

    def told(df: DataFrame) -> list[tuple[str, int, int, int]]:
        found = df.mapInPandas(scan, "kind string, first long, last long, n long").collect()
        return sorted(map(tuple, found), key=lambda r: r[1])

    known = routed.where(F.col("route").isin(*kinds)).select(PLACE, "route")
    found = told(known)
    if any(a[2] >= b[1] for a, b in zip(found, found[1:])):
        found = told(known.repartitionByRange(PLACE).sortWithinPartitions(PLACE))
    runs: list[tuple[str, int, int, int]] = []
    for kind, first, last, n in found:
        if runs and runs[-1][0] == kind:
            runs[-1] = (kind, runs[-1][1], last, runs[-1][3] + n)
        else:
            runs.append((kind, first, last, n))
    return runs


class _Stored:
    """A routed batch of any size, kept by the cluster. Runs are told by their places."""

    def __init__(self, routed: DataFrame, kinds: list[str]):
        self.routed, self.kinds = routed.persist(), kinds

    def runs(self) -> list[tuple[str, tuple[int, int, int, list[int] | None]]]:
        return [(kind, (first, last, n, None)) for kind, first, last, n in message_runs(self.routed, self.kinds)]

    def frame(self, kind: str, part) -> DataFrame:
        return self.routed.where((F.col("route") == kind) & F.col(PLACE).between(part[0], part[1])).drop(PLACE)

    def halves(self, kind: str, part) -> list:
        """Both halves of a part; none of a single message."""
        first, last, n, places = part
        if n == 1:
            return []
        if places is None:              # of a run that failed, no more than a batch's messages
            run = self.routed.where((F.col("route") == kind) & F.col(PLACE).between(first, last))
            places = sorted(r[PLACE] for r in run.select(PLACE).collect())
        half = len(places) // 2
        return [(p[0], p[-1], len(p), p) for p in (places[:half], places[half:])]

    def bury(self, failed: list, batch_id: int, path: str) -> None:
        letters = dead_letter_frame(self.routed.where(F.col("route").isin("malformed", "unknown_kind")), F.col("route"), batch_id)
        if failed:
            lost = self.routed.sparkSession.createDataFrame([(part[0],) for part in failed], f"{PLACE} long")
            letters = letters.unionByName(dead_letter_frame(self.routed.join(F.broadcast(lost), PLACE, "left_semi"), "handler_failed", batch_id))
        letters.write.mode("overwrite").parquet(path)

    def count(self) -> int:
        return self.routed.count()

    def close(self) -> None:
        self.routed.unpersist()


class _Held:
    """A routed batch whose few, short messages the driver holds, in order: read by one
    job, its runs are slices of it. A part is a range of the messages that have a handler."""

    def __init__(self, spark: SparkSession, rows: pa.Table, kinds: list[str]):
        rows = rows.sort_by(PLACE).combine_chunks()
        known = pc.is_in(rows["route"], pa.array(kinds, pa.string()))
        self.spark, self.n = spark, len(rows)
        self.whole = self.rows = None
        self.known, self.dead = rows.filter(known).drop_columns(PLACE), rows.filter(pc.invert(known))

    def runs(self) -> list[tuple[str, tuple[int, int]]]:
        if not len(self.known):
            return []
        runs = pc.run_end_encode(self.known["route"].combine_chunks())
        ends = runs.run_ends.to_pylist()
        return list(zip(runs.values.to_pylist(), zip([0, *ends], ends)))

    def frame(self, kind: str, part: tuple[int, int]) -> DataFrame:
        if self.whole is None:          # handed to the JVM once, not once a run
            self.whole = self.spark.createDataFrame(self.known, ROUTED)
        if part == (0, len(self.known)):
            return self.whole
        session = self.spark._jsparkSession
        if self.rows is None:
            self.rows, self.schema = self.whole._jdf.collectAsList(), session.parseDataType(ROUTED.json())
        return DataFrame(session.createDataFrame(self.rows.subList(*part), self.schema), self.spark)

    def halves(self, kind: str, part: tuple[int, int]) -> list[tuple[int, int]]:
        a, b = part
        half = a + (b - a) // 2
        return [(a, half), (half, b)] if b - a > 1 else []

    def bury(self, failed: list[tuple[int, int]], batch_id: int, path: str) -> None:
        lost = self.known.take(pa.array([a for a, _ in failed], pa.int64()))
        values = self.dead["value"].to_pylist() + lost["value"].to_pylist()
        reasons = self.dead["route"].to_pylist() + ["handler_failed"] * len(lost)
        replace_folder(self.spark, path, pa.table({
            "value": pa.array(values, pa.string()), "reason": pa.array(reasons, pa.string()),
            "batch_id": pa.array([batch_id] * len(values), pa.int64())}))

    def count(self) -> int:
        return self.n

    def close(self) -> None:
        pass


ROUTED = StructType([StructField(c, StringType()) for c in (*DECODED_COLUMNS, "route")])


def decoded_batch(kinds: list[str], place: Column) -> Callable[[DataFrame], DataFrame]:
    """A function of messages that reads and routes them: ``ROUTED`` and their place."""
    read, cells = _decoding()
    cells["route"] = _route(cells["status"], cells["kind"], kinds)
    out = [*[c.alias(name) for name, c in cells.items()], F.col(PLACE)]
    return lambda messages: messages.select("value", place.alias(PLACE), read).select(*out)


def batch_keeper(kinds: list[str], most: int | None) -> Callable[[DataFrame], _Stored | _Held]:
    """A function of batches, which are read and decoded once: by the driver where a
    batch has few and short messages, else by the cluster. ``most`` is what a batch can
    hold, where that is known. Columns are made once, not once a batch."""
    numbered, placed = decoded_batch(kinds, F.col("number")), decoded_batch(kinds, F.monotonically_increasing_id())
    # Of a long message nothing is fetched but that there is one.
    long = F.length("value") > HELD_LENGTH
    short = [F.col(PLACE), long.alias("_long"), *[F.when(~long, F.col(c)).alias(c) for c in ROUTED.names]]

    def keep(batch: DataFrame) -> _Stored | _Held:
        routed = batch if PLACE in batch.columns else (numbered if "number" in batch.columns else placed)(batch)
        if most is None or most <= HELD_MESSAGES:
            few = routed.select(*short)
            rows = (few.limit(HELD_MESSAGES + 1) if most is None else few).toArrow()
            if len(rows) <= HELD_MESSAGES and not pc.any(rows["_long"]).as_py():
                return _Held(batch.sparkSession, rows.drop_columns("_long"), kinds)
        return _Stored(routed, kinds)

    return keep


def make_batch_processor(handlers: dict[str, Handler], dead_path: str, log: list | None = None,
                         progress_path: str | None = None, most: int | None = None) -> Callable[[DataFrame, int], None]:
    """T3 + T4: the ``foreachBatch`` function. The batch is read and decoded once.
    Each run of messages of one kind is a handler call, in message order; malformed
    and unknown messages and those that fail alone go to ``dead_path`` (one folder per
    batch id, overwritten on replay, so a re-run batch never duplicates).
    ``progress_path`` gets a row per batch the same way, however many batches there
    are. Messages with a ``number`` are ordered by it, others by their place in the
    files read; those decoded already (``decoded_batch``) by the place they have.
    ``most``: messages that a batch can have, where that is known."""
    keep = batch_keeper(list(handlers), most)

    def process(batch: DataFrame, batch_id: int) -> None:
        kept = keep(batch)
        failed: list = []

        def handle(kind: str, part) -> None:
            try:
                handlers[kind](kept.frame(kind, part), batch_id)
            except Exception as e:  # noqa: BLE001 - a failed handler never stops the stream
                halves = kept.halves(kind, part)
                if not halves:
                    failed.append(part)
                    if log is not None:
                        log.append((batch_id, kind, "".join(traceback.format_exception_only(e))))
                for half in halves:
                    handle(kind, half)

        try:
            for kind, part in kept.runs():
                handle(kind, part)
            kept.bury(failed, batch_id, f"{dead_path}/batch_id={batch_id}")
            if progress_path:
                replace_folder(batch.sparkSession, f"{progress_path}/b={batch_id}", pa.table({
                    "batch_id": pa.array([batch_id], pa.int64()), "num_input_rows": pa.array([kept.count()], pa.int64())}))
        finally:
            kept.close()

    return process


def read_task_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = 1) -> DataFrame:
    """Task files (one JSON message per line) as a stream."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def consume(spark: SparkSession, source_path: str, handlers: dict[str, Handler],
            dead_path: str, checkpoint: str, max_files_per_trigger: int | None = 1,
            log: list | None = None, progress_path: str | None = None) -> None:
    """Drain what is there (``availableNow``), paced by files per trigger,
    committing (acknowledging) each batch through the checkpoint. The batches seen
    and their sizes are the table at ``progress_path`` (see ``read_progress``)."""
    stream = read_task_stream(spark, source_path, max_files_per_trigger)
    q = (stream.writeStream.foreachBatch(make_batch_processor(handlers, dead_path, log, progress_path))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def consume_log(spark: SparkSession, log_path: str, handlers: dict[str, Handler], dead_path: str,
                checkpoint: str, pace: int = 1, log: list | None = None, progress_path: str | None = None) -> None:
    """T7 over a message log: drain it, ``pace`` messages a batch, each acknowledged
    through the checkpoint after its handlers returned."""
    # Decoded within the stream, whose plan is made for a batch anyway.
    q = (decoded_batch(list(handlers), F.col("number"))(read_message_stream(spark, log_path, pace)).writeStream
         .foreachBatch(make_batch_processor(handlers, dead_path, log, progress_path, pace))
         .option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def read_progress(spark: SparkSession, progress_path: str) -> DataFrame:
    """(batch_id, num_input_rows) of every batch a consumer has finished."""
    return spark.read.schema("batch_id long, num_input_rows long").parquet(progress_path + "/b=*")
