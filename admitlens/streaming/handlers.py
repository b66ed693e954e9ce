"""The two task handlers, as ``foreachBatch`` callbacks.

What an ingest adds (rows, rejects, watermarks, issues) is staged and becomes visible
with the batch's commit marker, the last step. The batch's id is a digest of its
messages: a replay of messages that were committed does nothing, and one of messages
whose handler died replaces what it had staged."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.operators import extract as E
from admitlens.operators import incremental as I
from admitlens.operators import load as L
from admitlens.operators import normalize as N
from admitlens.operators import questions as Q
from admitlens.session import store
from admitlens.sources.tables import ApplicantsTable, WatermarkTable


def run_id(messages: DataFrame) -> str | None:
    """Digest of a run's messages, whatever their order; None without any."""
    r = messages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("a"),
                     F.sum(F.xxhash64(F.lit(1), "value").cast("decimal(38,0)")).alias("b")).first()
    return f"run-{r['n']}-{r['a']}-{r['b']}" if r["n"] else None


def ingest_handler(table: ApplicantsTable, pages: Callable[[], DataFrame],
                   base_url: str = "https://example.test/", infer_fn=None,
                   program_dict: DataFrame | None = None,
                   university_dict: DataFrame | None = None,
                   stats: list | None = None, issues_path: str | None = None,
                   watermarks: WatermarkTable | None = None, source: str = "listing",
                   waves: list | None = None):
    """T5: on a run of 'scrape_new_data' messages: parse the pages in waves up to the
    first fully seen one (I3), keep what is new (I6), standardise it (N13) and load it
    (L8). With ``issues_path`` the per-page issues (E11) of the pages parsed are kept
    per run; with ``watermarks`` the last key loaded is noted (I5)."""

    def handle(messages: DataFrame, batch_id: int) -> None:
        run = run_id(messages)
        if run is None or table.commits.has(run):
            return
        issues: list[DataFrame] = []

        def records(some: DataFrame) -> DataFrame:
            if not issues_path:
                return E.extract_listing(some, base_url)
            rows = store(E.listing_rows(some, base_url), "rows")     # one parse for both
            issues.append(E.extraction_issues(some, base_url, rows))
            return E.extract_listing(some, base_url, rows=rows)

        new = I.incremental_pull(pages(), records, table.scan(), waves=waves)
        if issues:
            reduce(DataFrame.unionByName, issues).write.mode("overwrite").parquet(f"{issues_path}/batch_id={batch_id}")
        if new.isEmpty():  # nothing new: nothing to standardise or load
            staged, result = table.stage(run), {"inserted": 0, "skipped": 0, "rejected": 0}
        else:
            enriched = N.enrich(new, "university", "program", infer_fn, program_dict, university_dict)
            staged, frame = L.stage_batch(table, enriched, order_cols=["p_id"], batch_id=run)
            result = frame.first().asDict()
        try:
            if watermarks is not None and result["inserted"]:
                last = new.agg(F.max("p_id").alias("v")).select(
                    F.lit(source).alias("s"), "v", F.current_timestamp().cast("timestamp_ntz").alias("t"))
                staged.watermarks(watermarks, I.advance_watermark(
                    watermarks.scan().filter(F.col("source") == source), last, "s", "v", "t"))
            staged.commit()
        except Exception:
            staged.roll_back()
            raise
        if stats is not None:
            stats.append((batch_id, result))

    return handle


def refresh_handler(table: ApplicantsTable, report_path: str):
    """Make sure the table exists, then answer every question anew (Q13) and
    replace the stored report; of the table only batches appended since are scanned."""

    def handle(messages: DataFrame, batch_id: int) -> None:
        if messages.isEmpty():
            return
        table.ensure()
        answers = Q.refreshed_answers(table)
        answers.withColumn("batch_id", F.lit(batch_id).cast("long")) \
            .write.mode("overwrite").parquet(report_path)

    return handle
