"""Record files, envelopes, JSON Lines, dictionaries, chunked write.

All reads take an explicit schema (no inference)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.functions.text import CORRUPT, json_object, ws_trim
from admitlens.operators.numbering import with_row_index
from admitlens.sources.json_array import read_json_array

# Records per JSON array when writing the array format (bounds every group).
ARRAY_CHUNK_ROWS = 1000


def read_records(spark: SparkSession, path: str, schema: T.StructType,
                 multiline: bool = False) -> DataFrame:
    """Records from JSON. ``multiline=True`` for files that each hold one
    (possibly indented) JSON array, which many tasks read (``read_json_array``);
    otherwise one object or one array per line, which splits across tasks."""
    if multiline:
        return read_json_array(spark, path, schema)
    return spark.read.schema(schema).json(path)


def read_envelope(df: DataFrame, json_col: str, schema: T.StructType, unread_col: str | None = None) -> DataFrame:
    """A JSON text that is either a list of rows or ``{"rows": [...]}``;
    any other shape (or bad JSON) yields no rows. A typed, permissive parse: of equal
    keys the last counts, NaN is a number, and a value of the wrong type is NULL and
    costs no other. With ``unread_col`` every text without a list of rows gives one row
    of NULLs and its reason there ('malformed' or 'no_rows'), so none is lost unseen."""
    text = F.col(json_col)
    envelope = F.when(text.rlike(r"^\s*\["), F.concat(F.lit('{"rows":'), text, F.lit("}"))).otherwise(text)
    read = json_object(envelope, f"rows {T.ArrayType(schema).simpleString()}")
    keep = [c for c in df.columns if c != json_col]
    d = df.select(*keep, read.alias("_read"))
    # A wrong type inside marks the text too, with its rows read as far as they go.
    rows = F.col("_read.rows")
    if unread_col is None:
        return d.select(*keep, F.explode(rows).alias("_row")).select(*keep, "_row.*")
    why = F.when(rows.isNull(), F.when(F.col(f"_read.{CORRUPT}").isNull(), "no_rows").otherwise("malformed"))
    d = d.where(rows.isNull() | (F.size(rows) > 0)).select(*keep, F.explode_outer(rows).alias("_row"), why.alias(unread_col))
    return d.select(*keep, "_row.*", unread_col)


def write_records(df: DataFrame, path: str, fmt: str = "json_array") -> None:
    """S3: write records, replacing the target.

    ``json_array``: arrays of at most ARRAY_CHUNK_ROWS objects, one per line, made by
    each task of its own rows, without a shuffle (readable by ``read_records``);
    ``json`` / ``parquet``: plain writers."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        return
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            full = len(held) - len(held) % ARRAY_CHUNK_ROWS
            if full:
                yield lines(held[:full])
                held = held[full:]
        if held:
            yield lines(held)

    def lines(rows: list[str]) -> pa.RecordBatch:
        each = range(0, len(rows), ARRAY_CHUNK_ROWS)
        return pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(rows[i:i + ARRAY_CHUNK_ROWS]) + "]" for i in each])], names=["value"])

    rows.mapInArrow(arrays, "value string").write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object per line, nulls kept; overwrite or append."""
    (df.write.mode("append" if append else "overwrite")
     .option("ignoreNullFields", False).json(path))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Text lines -> DataFrame(name, pos): trimmed, blank lines dropped,
    file order kept (pos = file rank * 2^32 + line number). A file of any size is read
    by as many tasks as it has splits. A missing path gives an empty dictionary."""
    schema = "name string, pos long"
    try:
        raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                           "value", F.monotonically_increasing_id().alias("_at"))
        raw.schema  # noqa: B018 - resolve now so a missing path surfaces here
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
    # Lines are numbered within their split; the splits' counts (a row each) are added up.
    splits = raw.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    rank = F.dense_rank().over(Window.orderBy("_file"))
    splits = splits.select("_file", "_block", F.coalesce(before, F.lit(0)).alias("_before"), rank.cast("long").alias("_rank"))
    place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1
    lines = raw.withColumn("_place", place).join(splits, ["_file", "_block"])
    return lines.select(ws_trim(F.col("value")).alias("name"), (F.col("_rank") * (1 << 32) + F.col("_before") + F.col("_place")).alias("pos")) \
        .filter(F.col("name") != "")


def chunked_write_merge(df: DataFrame, n: int, path: str,
                        fn: Callable[[DataFrame], DataFrame] = lambda d: d,
                        order: list | None = None) -> DataFrame:
    """Split rows into ``n`` contiguous chunks (the last one takes the
    remainder), process with ``fn``, write one folder per chunk, read the
    merged result back (with its ``chunk`` column).

    The numbering sorted the rows into contiguous ranges, so each task holds
    one or two chunks' rows: the write needs no extra shuffle, and a chunk is a
    folder of files written by many tasks (a chunk is never funnelled through
    one task, whatever its size)."""
    spark = df.sparkSession
    indexed = with_row_index(df, order, name="_pos")
    total = indexed.count()
    size = max(total // n, 1)
    chunk = F.least(F.floor(F.col("_pos") / size), F.lit(n - 1)).cast("int")
    out = fn(indexed.withColumn("chunk", chunk).drop("_pos"))
    out.write.mode("overwrite").partitionBy("chunk").parquet(path)
    return spark.read.parquet(path)
