"""Incremental pulls: which records are new, per-page novelty, the
early stop at the first fully seen page, consecutive numbering after the
table's last key, watermark upkeep, the update and the full build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.operators.numbering import running_totals, with_row_index
from admitlens.session import DEFAULT_BROADCAST_ROWS, bounded_rows, cut_lineage, store


def known_flag(batch: DataFrame, table: DataFrame, col: str = "url",
               out_col: str = "is_known",
               max_broadcast: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``batch`` plus a NULL-safe membership flag of ``col`` in ``table``.

    A bounded batch has its distinct values broadcast and the table is only
    probed (never shuffled); otherwise the optimizer / AQE plans the join."""
    vals = batch.select(F.col(col).alias("_kv")).distinct()
    tab = table.select(F.col(col).alias("_kv"))
    small = bounded_rows(vals, max_broadcast)
    if small:
        seen = tab.join(F.broadcast(vals), tab["_kv"].eqNullSafe(vals["_kv"]), "left_semi") \
            .distinct()
    else:
        seen = tab.distinct()
    seen = seen.withColumn("_hit", F.lit(True))
    j = batch.join(F.broadcast(seen) if small else seen,
                   batch[col].eqNullSafe(seen["_kv"]), "left")
    return j.withColumn(out_col, F.coalesce(F.col("_hit"), F.lit(False))).drop("_kv", "_hit")


def new_by_url(batch: DataFrame, table: DataFrame, col: str = "url") -> DataFrame:
    """Records whose URL is not in the table; a NULL URL matches a NULL."""
    return known_flag(batch, table, col).filter(~F.col("is_known")).drop("is_known")


def page_novelty(flagged: DataFrame, page_col: str = "page_id") -> DataFrame:
    """Per page: new records and all records (from a known-flagged batch)."""
    return flagged.groupBy(page_col).agg(
        F.count_if(~F.col("is_known")).alias("new"), F.count(F.lit(1)).alias("total"))


def first_seen_page(novelty: DataFrame, page_col: str = "page_id"):
    """The first page (in page order) that has rows but none new; None if none."""
    row = novelty.agg(F.min(F.when((F.col("total") > 0) & (F.col("new") == 0),
                                   F.col(page_col))).alias("stop")).first()
    return row["stop"] if row else None


def stop_at_seen_page(batch: DataFrame, novelty: DataFrame, page_col: str = "page_id") -> DataFrame:
    """Keep the pages before the first fully seen one (pages without rows
    do not stop anything). The stop page is a one-row scalar."""
    stop = first_seen_page(novelty, page_col)
    return batch if stop is None else batch.filter(F.col(page_col) < F.lit(stop))


def next_key(table: DataFrame, key: str = "p_id") -> int:
    """First free key: greatest(row count, max key) + 1, so gaps never collide."""
    row = table.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("m")).first()
    return max(int(row["n"] or 0), int(row["m"] or 0)) + 1


def number_by_page(df: DataFrame, page_col: str, pos_col: str, start: int, out_col: str = "p_id") -> DataFrame:
    """I4 in page / position order without sorting the rows globally: rows are
    counted per page, the counts (a row per page) are added up, and each row adds
    its place within its page. ``df`` is read twice, so pass a stored frame."""
    counts = df.groupBy(page_col).agg(F.count(F.lit(1)).alias("_n"))
    first = running_totals(counts, page_col, "_n", "_before").select(F.col(page_col).alias("_page"), "_before")
    w = Window.partitionBy(page_col).orderBy(pos_col)
    return (df.withColumn("_place", F.row_number().over(w))
            .join(first, F.col(page_col).eqNullSafe(F.col("_page")))
            .withColumn(out_col, (F.lit(start) + F.col("_before") + F.col("_place") - 1).cast("long"))
            .drop("_page", "_before", "_place"))


def number_rows(df: DataFrame, order: list[Column | str], start: int,
                out_col: str = "p_id") -> DataFrame:
    """I4: consecutive ids start, start+1, … in ``order`` (distributed; no
    single-task window)."""
    return with_row_index(df, order, start=start, name=out_col)


def advance_watermark(watermarks: DataFrame, batch: DataFrame, source: Column | str,
                      value: Column | str, ts: Column | str) -> DataFrame:
    """One row per source: the last value seen and its time; existing
    watermarks take part, so a source absent from the batch keeps its row.
    ``max_by`` aggregates partially, so a hot source costs one row per task."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x

    fresh = batch.select(c(source).cast("string").alias("source"),
                         c(value).cast("string").alias("last_seen"),
                         c(ts).cast("timestamp_ntz").alias("updated_at"))
    both = watermarks.select("source", "last_seen",
                             F.col("updated_at").cast("timestamp_ntz")).unionByName(fresh)
    best = F.max_by(F.struct("last_seen", "updated_at"), F.struct("updated_at", "last_seen"))
    return both.groupBy("source").agg(best.alias("w")).select("source", "w.*")


def _kept_until(rows: DataFrame, table: DataFrame, page_col: str, url_col: str) -> tuple[DataFrame, object]:
    """(new rows of the pages before the first fully seen one, that page or None) of
    stored ``rows``. The rows are met with the table once; their flags are stored."""
    flagged = store(known_flag(rows, table, url_col), "flagged")
    stop = first_seen_page(page_novelty(flagged, page_col), page_col)
    kept = flagged if stop is None else flagged.filter(F.col(page_col) < F.lit(stop))
    return kept.filter(~F.col("is_known")).drop("is_known"), stop


def _numbered(new: DataFrame, table: DataFrame, page_col: str, pos_col: str, key: str) -> DataFrame:
    if new.isEmpty():  # nothing new: a no-op, no numbering work
        return new.withColumn(key, F.lit(None).cast("long"))
    return number_by_page(new, page_col, pos_col, next_key(table, key), key)


def incremental_update(batch: DataFrame, table: DataFrame, page_col: str = "page_id",
                       pos_col: str = "record_no", url_col: str = "url",
                       key: str = "p_id") -> DataFrame:
    """I6 of records that are there already: new records of the pages before the
    first fully seen page, numbered after the table's last key in page/row order.
    Returns the rows to append (empty when nothing is new). Pages that are still to be
    parsed: ``incremental_pull``."""
    new, _ = _kept_until(store(batch, "batch"), table, page_col, url_col)
    return _numbered(store(new, "new"), table, page_col, pos_col, key)


FIRST_WAVE = 256         # pages of the first wave; each further one doubles
EXACT_WAVE = 4096        # wider waves end at an approximate quantile of the page ids


def next_wave(pages: DataFrame, page_col: str, after, width: int):
    """(last page id of the wave, whether pages are left behind it) of the ``width``
    pages or so behind ``after``; None if there are none. Page ids alone are read."""
    rest = pages.select(page_col).where(F.col(page_col).isNotNull())
    rest = rest if after is None else rest.where(F.col(page_col) > F.lit(after))
    size = rest.agg(F.count(F.lit(1)).alias("n"), F.max(page_col).alias("last")).first()
    if not size["n"]:
        return None
    if size["n"] <= width:
        return size["last"], False
    if width <= EXACT_WAVE:
        last = rest.orderBy(page_col).limit(width).agg(F.max(page_col).alias("p")).first()["p"]
    else:
        last = rest.agg(F.percentile_approx(page_col, width / size["n"], F.lit(100_000)).alias("p")).first()["p"]
    return last, last < size["last"]


def incremental_pull(pages: DataFrame, parse: Callable[[DataFrame], DataFrame], table: DataFrame,
                     page_col: str = "page_id", pos_col: str = "record_no", url_col: str = "url", key: str = "p_id",
                     first_wave: int = FIRST_WAVE, waves: list | None = None) -> DataFrame:
    """I3 + I6 over pages that are not parsed yet. Pages are parsed in waves, in page
    order and each twice as wide as the one before; the first fully seen page ends
    the pull, so pages beyond its wave are never parsed, and fewer than twice those
    needed are (but for the first wave). Pages without an id are parsed last, if no
    page has ended the pull.

    ``parse`` gives the records of some pages, which are stored; ``waves`` gets (after,
    last, stop page) of each wave."""
    after, width, new, stop = None, first_wave, None, None

    def pull(some: DataFrame, last) -> None:
        nonlocal new, stop
        rows = store(parse(some), "wave")
        kept, stop = _kept_until(rows, table, page_col, url_col)
        new = kept if new is None else new.unionByName(kept)
        if waves is not None:
            waves.append((after, last, stop))

    more = True
    while stop is None and more and (wave := next_wave(pages, page_col, after, width)) is not None:
        last, more = wave
        inside = F.col(page_col) <= F.lit(last)
        pull(pages.where(inside if after is None else inside & (F.col(page_col) > F.lit(after))), last)
        after, width = last, 2 * width
    if stop is None:
        pull(pages.where(F.col(page_col).isNull()), None)
    return _numbered(store(new, "new"), table, page_col, pos_col, key)


def full_build(records: DataFrame, page_col: str = "page_id", pos_col: str = "record_no",
               key: str = "p_id") -> DataFrame:
    """Every record of every page, ids from 1 in page/row order."""
    return number_by_page(cut_lineage(records), page_col, pos_col, 1, key)
