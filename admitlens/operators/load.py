"""Conform records to the table, set bad rows aside, dedupe within the
batch, insert-ignore against the table, count what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.functions.dates import parse_date
from admitlens.functions.numbers import try_double, try_key
from admitlens.functions.records import combine_names, parse_prefixed_number
from admitlens.schema import APPLICANT_COLUMNS, KEY_SPELLINGS
from admitlens.session import DEFAULT_BROADCAST_ROWS, bounded_rows, maybe_broadcast, store

NUMERIC = ["gpa", "gre", "gre_v", "gre_aw"]
ORDER_COL = "_load_pos"
ROW_COL = "_load_row"


def _pick(df: DataFrame, field: str, map_col: str | None = None) -> Column:
    """First present, non-null spelling of a field (NULL if none present).
    With ``map_col`` the record is a map (key case kept, like a dict)."""
    if map_col is not None:
        return F.coalesce(*[F.col(map_col)[n] for n in KEY_SPELLINGS[field]], F.lit(None))
    present = [F.col(f"`{n}`") for n in KEY_SPELLINGS[field] if n in df.columns]
    if not present:
        return F.lit(None)
    return present[0] if len(present) == 1 else F.coalesce(*present)


def _text(c: Column) -> Column:
    return c.cast("string")


def conform(df: DataFrame, keep: list[str] | None = None,
            map_col: str | None = None) -> DataFrame:
    """L1: any known key spelling -> the 16 table columns, typed; absent ->
    NULL, unknown columns dropped. The record is either columns of ``df`` or a
    map column ``map_col`` (JSON text read as map<string,string>). Raw key /
    numbers are kept (``_raw_*``) for the validation step; ``keep`` lists extra
    columns to carry along."""
    def pick(field: str) -> Column:
        return _pick(df, field, map_col)

    raw_key = _text(pick("applicant_number"))
    gpa_txt = _text(pick("gpa"))
    gpa = F.coalesce(try_double(gpa_txt), parse_prefixed_number(gpa_txt, "GPA"))
    date_raw = pick("date_posted")
    date_type = "string" if map_col else dict(df.dtypes).get(
        next((n for n in KEY_SPELLINGS["date_posted"] if n in df.columns), ""), "string")
    date = date_raw.cast("date") if date_type in ("date", "timestamp", "timestamp_ntz") \
        else parse_date(_text(date_raw))
    out = [
        try_key(raw_key).alias("p_id"),
        combine_names(_text(pick("university")), _text(pick("program"))).alias("program"),
        _text(pick("degree_type")).alias("degreeType"),
        date.alias("datePosted"),
        _text(pick("status")).alias("status"),
        _text(pick("status_date")).alias("statusDate"),
        _text(pick("semester")).alias("semester"),
        _text(pick("citizenship")).alias("citizenship"),
        gpa.alias("gpa"),
        try_double(_text(pick("gre"))).alias("gre"),
        try_double(_text(pick("gre_v"))).alias("gre_v"),
        try_double(_text(pick("gre_aw"))).alias("gre_aw"),
        _text(pick("comment")).alias("comment"),
        _text(pick("url")).alias("url"),
        _text(pick("llm_generated_program")).alias("llm_generated_program"),
        _text(pick("llm_generated_university")).alias("llm_generated_university"),
        raw_key.alias("_raw_key"),
    ] + [_text(pick(n)).alias(f"_raw_{n}") for n in NUMERIC]
    return df.select(*out, *(keep or []))


def flag_invalid(conformed: DataFrame) -> DataFrame:
    """L6 (flagging half): ``reject_reason`` is NULL for a loadable row, else
    the first broken rule: missing key, key not an integer, a score that is
    present but not a number."""
    reason = (F.when(F.col("_raw_key").isNull(), F.lit("missing_key"))
              .when(F.col("p_id").isNull(), F.lit("bad_key")))
    for n in NUMERIC:
        reason = reason.when(F.col(f"_raw_{n}").isNotNull() & F.col(n).isNull()
                             & (F.trim(F.col(f"_raw_{n}")) != ""), F.lit(f"bad_number:{n}"))
    return conformed.withColumn("reject_reason", reason)


def reject_invalid(conformed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows with the table columns, rejects with their reason)."""
    flagged = flag_invalid(conformed)
    good = flagged.filter(F.col("reject_reason").isNull())
    rejects = flagged.filter(F.col("reject_reason").isNotNull())
    return good, rejects


def dedupe_first(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """L4: the first row per key by ``order_col``. ``min_by`` aggregates
    partially before the shuffle, so a hot key costs one row per map task."""
    cols = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*cols), F.struct(F.col(order_col), *[F.col(c) for c in cols]))
    return df.groupBy(key).agg(best.alias("_first")).select(key, "_first.*")


def insert_ignore(target: DataFrame, batch: DataFrame, key: str,
                  max_broadcast_keys: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Batch rows whose key is not in the target (existing rows never change).

    When the batch is small (checked), its keys are broadcast and the table is
    only scanned (key column) and probed - the table is never shuffled. Otherwise
    a plain anti join, planned by the optimizer / AQE."""
    keys = batch.select(key).distinct()
    if bounded_rows(keys, max_broadcast_keys):
        existing = target.select(key).join(F.broadcast(keys), key, "left_semi")
        return batch.join(F.broadcast(existing), key, "left_anti") \
            if bounded_rows(existing, max_broadcast_keys) else batch.join(existing, key, "left_anti")
    return batch.join(target.select(key), key, "left_anti")


def load_stats(flagged: DataFrame, new_rows: DataFrame, key: str = "p_id") -> DataFrame:
    """One row (inserted, skipped, rejected). Skipped = valid rows that did
    not become a new row (duplicate within the batch or already in the table)."""
    per = flagged.agg(
        F.count_if(F.col("reject_reason").isNull()).alias("_valid"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
        F.lit(0).cast("long").alias("inserted"))
    ins = new_rows.agg(F.lit(0).cast("long").alias("_valid"), F.lit(0).cast("long").alias("rejected"),
                       F.count(F.lit(1)).alias("inserted"))
    both = per.unionByName(ins).agg(
        F.sum("inserted").alias("inserted"),
        (F.sum("_valid") - F.sum("inserted")).alias("skipped"),
        F.sum("rejected").alias("rejected"))
    return both.select(*[F.col(c).cast("long") for c in ("inserted", "skipped", "rejected")])


def _ordered(batch: DataFrame, order_cols: list[Column | str] | None) -> DataFrame:
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols or []]
    if not order:
        if batch.inputFiles():
            raise ValueError("rows come from files: say by order_cols which of a key's rows is first")
        order = [F.monotonically_increasing_id()]
    return batch.withColumn(ORDER_COL, F.struct(*order))


def prepare_batch(batch: DataFrame, target: DataFrame, map_col: str | None = None,
                  order_cols: list[Column | str] | None = None) -> tuple[DataFrame, DataFrame]:
    """L1 -> L6 -> L4 -> L5 without writing: (flagged batch, rows to append).

    ``order_cols`` say which of several rows of a key came first (for files:
    ``file_order()``). Rows made in memory come in their own order; rows read
    from files have none that Spark keeps, so it must be given."""
    flagged = flag_invalid(conform(_ordered(batch, order_cols), keep=[ORDER_COL], map_col=map_col))
    good = flagged.filter(F.col("reject_reason").isNull()).select(*APPLICANT_COLUMNS, ORDER_COL)
    first = dedupe_first(good, "p_id", ORDER_COL).drop(ORDER_COL)
    return flagged, insert_ignore(target, first, "p_id").select(*APPLICANT_COLUMNS)


def file_order() -> list[Column]:
    """Order of rows read from files: by path, then by place in the file."""
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def stage_batch(table, batch: DataFrame, map_col: str | None = None,
                order_cols: list[Column | str] | None = None, batch_id: str | None = None):
    """L8 up to the commit: (staged batch, one-row stats frame). Conform, set rejects
    aside, dedupe, insert-ignore; rows and rejects are staged under ``batch_id``
    (default: a digest of the whole batch), so a replay replaces its own.

    The flagged batch is written once. Which rows are new is decided on keys, order
    and row numbers alone; table files that cannot hold a key are not read; the rows
    themselves are then read once more, for the append."""
    flagged = flag_invalid(conform(_ordered(batch, order_cols), keep=[ORDER_COL], map_col=map_col))
    flagged = store(flagged.withColumn(ROW_COL, F.monotonically_increasing_id()), "flagged")
    valid = F.col("reject_reason").isNull()
    counts = flagged.agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("rejected"),
                         F.sum(F.xxhash64(*flagged.drop(ORDER_COL, ROW_COL).columns).cast("decimal(38,0)")).alias("h")).first()
    staged = table.stage(batch_id or f"{counts['valid'] + counts['rejected']}-{counts['h'] or 0}")
    firsts = flagged.where(valid).groupBy("p_id").agg(F.min(F.struct(ORDER_COL, ROW_COL)).alias("o")).select("p_id", f"o.{ROW_COL}")
    firsts = store(firsts, "first-rows")
    known = table.scan_for_keys(firsts.select("p_id"), DEFAULT_BROADCAST_ROWS)
    new = store(insert_ignore(known, firsts, "p_id"), "new-keys")
    inserted = new.count()
    staged.rows(flagged.join(maybe_broadcast(new.select(ROW_COL)), ROW_COL, "left_semi").select(*APPLICANT_COLUMNS))
    staged.rejects(flagged.where(~valid).drop(ORDER_COL, ROW_COL))
    stats = [(inserted, counts["valid"] - inserted, counts["rejected"])]
    return staged, table.spark.createDataFrame(stats, "inserted long, skipped long, rejected long")


def load_batch(table, batch: DataFrame, map_col: str | None = None,
               order_cols: list[Column | str] | None = None, batch_id: str | None = None) -> DataFrame:
    """Stage a batch and commit it; returns the one-row stats frame. Rows and
    rejects become visible together. Loading the same batch twice inserts nothing the
    second time. ``order_cols``: see prepare_batch."""
    staged, stats = stage_batch(table, batch, map_col, order_cols, batch_id)
    staged.commit()
    return stats
