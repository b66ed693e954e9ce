"""S1 for one large JSON array: a file read by many tasks.

The text source splits a file at any byte and starts at the next closing brace. What a
brace means depends on what stands before it (is it inside a string, how deep), so each
split first tells, for either state of its first character, the state it ends in, its
change of depth and the records it ends; these few rows are added up over the splits of
a file, in order. Knowing its true state, a split then cuts its text into records; the
pieces of records that lie across splits are joined by their number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPED = re.compile(r"\\.", re.S)
STRING_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
BETWEEN = re.compile(r'(?:[^"{]|"(?:[^"\\]|\\.)*")*', re.S)      # what is no record


def record_start(fragment: str, inside: int) -> str:
    """The fragment from its first record on, outside all records before."""
    at = 0
    if inside:                   # an element that is a string
        rest = STRING_REST.match(fragment)
        if rest is None:
            return ""
        at = rest.end()
    at = BETWEEN.match(fragment, at).end()
    return fragment[at:] if fragment[at:at + 1] == "{" else ""


def after(fragment: str, inside: int, depth: int) -> tuple[int, int, bool]:
    """(inside a string, depth, whether a record ends) behind a fragment and the closing
    brace that follows it."""
    parts = (ESCAPED.sub("", fragment) if "\\" in fragment else fragment).split('"')
    depth += sum(p.count("{") for p in parts[inside::2])
    inside ^= (len(parts) - 1) & 1
    if inside or depth == 0:     # in a string, or behind the last record
        return inside, depth, False
    return 0, depth - 1, depth == 1


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON files that each hold one array of objects, however laid out; a
    file of any size is read by as many tasks as it has splits. Order is not kept. Other
    elements than objects are passed over; a record that cannot be read gives NULLs."""
    rows = _fragments(spark, path)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a split, for a start outside and inside a string: state, depths and what is
        # needed to count its records from any depth: how often each depth is reached.
        now, states = None, []
        for batch in batches:
            for where, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (where, block) != now:
                    if now is not None:
                        yield told(now, states)
                    now, states = (where, block), [[i, 0, 0, {}] for i in (0, 1)]
                for s in states:
                    parts = (ESCAPED.sub("", value) if "\\" in value else value).split('"')
                    s[1] += sum(p.count("{") for p in parts[s[0]::2])
                    s[0] ^= (len(parts) - 1) & 1
                    if not s[0]:
                        s[1] -= 1
                        s[3][s[1]] = s[3].get(s[1], 0) + 1
        if now is not None:
            yield told(now, states)

    def told(now, states) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "path": now[0], "block": now[1], "from": i, "inside": s[0], "depth": s[1],
            "ends": [{"depth": d, "n": n} for d, n in sorted(s[3].items())]} for i, s in enumerate(states)], schema=told_type)

    told_type = pa.schema([("path", pa.string()), ("block", pa.int64()), ("from", pa.int32()), ("inside", pa.int32()), ("depth", pa.int64()),
                           ("ends", pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())])))])
    found = rows.mapInArrow(tell, "path string, block long, `from` int, inside int, depth long, "
                                  "ends array<struct<depth:bigint,n:bigint>>").collect()      # two rows a split
    by: dict[str, dict[int, dict[int, tuple]]] = {}
    for r in found:
        by.setdefault(r["path"], {}).setdefault(r["block"], {})[r["from"]] = (r["inside"], r["depth"], {e["depth"]: e["n"] for e in r["ends"]})
    starts: dict[tuple[str, int], tuple[int, int, int]] = {}
    for where, blocks in by.items():
        inside, depth, records = 0, 0, 0
        for block in sorted(blocks):
            starts[where, block] = inside, depth, records
            end, change, ends = blocks[block][inside]
            records += ends.get(-depth, 0)
            inside, depth = end, max(depth + change, 0)
    held = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, number, begun, whole = None, 0, 0, 0, [], False

        def piece() -> list[tuple]:
            return [(*now, number, False, "".join(begun))] if now is not None and begun else []

        for batch in batches:
            out: list[tuple] = []
            for where, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (where, block) != now:
                    out += piece()
                    now, begun = (where, block), []
                    inside, depth, number = held.value[now]
                    whole = depth == 0           # no record has begun before this split
                part = value if depth else record_start(value, inside)
                inside, depth, ends = after(value, inside, depth)
                if depth or ends:
                    begun.append(part + "}")
                if ends:
                    out.append((*now, number, whole, "".join(begun)))
                    number, begun, whole = number + 1, [], True
            if out:
                yield batch_of(out)
        if piece():
            yield batch_of(piece())

    def batch_of(out) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["path", "block", "record", "whole", "text"])

    pieces = rows.mapInArrow(cut, "path string, block long, record long, whole boolean, text string")
    # Pieces of records across splits: two a split, but for records longer than one.
    joined = pieces.where(~F.col("whole")).groupBy("path", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    texts = pieces.where("whole").select("text").unionByName(joined.select("text"))
    return texts.select(F.from_json("text", schema).alias("r")).select("r.*")
