"""Plan checks: pushdown, one scan for the bundle, partitioned windows."""

from __future__ import annotations

from admitlens.operators import extract as E
from admitlens.operators import questions as Q
from admitlens.plans.applicants_view import applicants_view
from admitlens.plans.listing import render_listing
from admitlens.plans.applicants_view import applicant_records


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_on_a_stored_table_push_filters(spark, sf_small, tmp_path):
    path = str(tmp_path / "av")
    applicants_view(spark, sf_small).write.parquet(path)
    df = spark.read.parquet(path)
    plan = _plan(Q.term_count(df))
    assert "PushedFilters: [IsNotNull(semester), EqualTo(semester,Fall 2026)]" in plan
    assert "ReadSchema: struct<semester:string>" in plan


def test_bundle_is_one_scan(spark, sf_small, tmp_path):
    path = str(tmp_path / "av2")
    applicants_view(spark, sf_small).write.parquet(path)
    plan = _plan(Q.scalar_bundle(spark.read.parquet(path)))
    assert plan.count("FileScan parquet") == 1


def test_nothing_is_shuffled_after_the_parse(spark, sf_small):
    pages = spark.createDataFrame([(1, "u", "<table></table>")], "page_id long, url string, html string")
    for df in (E.extract_listing(pages), E.stitch_followers(E.page_elements(pages, "tr"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_term_questions_prune_partitions(spark, sf_small, tmp_path):
    from admitlens.sources.tables import ApplicantsTable

    t = ApplicantsTable(spark, str(tmp_path / "tbl"))
    t.append(applicants_view(spark, sf_small))
    df = t.scan(with_partition=True)
    plan = _plan(Q.term_acceptance_pct(df))
    assert "PartitionFilters: [isnotnull(term_year" in plan and "(term_year" in plan
    assert Q.term_count(df).first()[0] == Q.term_count(t.scan()).first()[0] == 90


def test_hot_key_is_aggregated_before_the_shuffle(spark):
    """One key holds a third of all rows: dedupe / watermark / novelty all
    combine map-side, so the hot key reaches the shuffle as one row per task."""
    from pyspark.sql import functions as F

    from admitlens.operators import incremental as I
    from admitlens.operators import load as L

    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("pos"), (F.col("id") * 7 % 1000).alias("v")).repartition(8)
    first = L.dedupe_first(df, "k", "pos")
    plan = _plan(first)
    assert "partial_min_by" in plan
    assert first.filter("k = 0").first()["pos"] == 0 and first.count() == n - n // 3 + 1
    wm = I.advance_watermark(spark.createDataFrame([], "source string, last_seen string, "
                                                       "updated_at timestamp_ntz"),
                             df.withColumn("ts", F.timestamp_seconds("pos").cast("timestamp_ntz")),
                             F.when(F.col("k") == 0, "hot").otherwise("cold"), "v", "ts")
    assert "partial_max_by" in _plan(wm)
    got = {r.source: r.last_seen for r in wm.collect()}
    assert got == {"hot": str((n - 3) * 7 % 1000), "cold": str((n - 1) * 7 % 1000)}
    flagged = I.known_flag(df.select(F.concat(F.lit("u"), F.col("k").cast("string")).alias("url"),
                                     (F.col("pos") % 50).alias("page_id")),
                           spark.createDataFrame([("u0",)], "url string"))
    nov = I.page_novelty(flagged)
    assert "partial_count" in _plan(nov) or "partial_count_if" in _plan(nov)
    assert flagged.filter("is_known").count() == n // 3


def test_building_a_query_on_pages_starts_no_job(spark, sf_small):
    from admitlens.plans import registry

    registry.load_all()
    sc = spark.sparkContext
    for name in ("explode_elements", "stitch_followers", "scan_pages", "extract_listing"):
        sc.setJobGroup(f"build-{name}", name)
        registry.QUERIES[name](spark, sf_small)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        assert len(jobs) <= 6, name        # Parquet footers, one a table; no data is read
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_top_k_and_small_batch_insert_plans(spark, tmp_path):
    from pyspark.sql import functions as F

    from admitlens.operators import load as L
    from admitlens.operators import report as R

    big = spark.range(0, 200000).select(F.col("id").cast("int").alias("p_id"),
                                        (F.col("id") % 97).alias("v"))
    path = str(tmp_path / "target")
    big.write.parquet(path)
    target = spark.read.parquet(path)
    top = R.order_limit(target, [F.col("v").desc(), F.col("p_id")], 500)
    assert "TakeOrderedAndProject" in _plan(top) and top.count() == 500
    batch = spark.createDataFrame([(5, 1), (199999, 2), (300000, 3)], "p_id int, v long")
    new = L.insert_ignore(target, batch, "p_id")
    plan = _plan(new)
    # The table is probed through broadcast joins and read on its key only:
    # it is never shuffled.
    assert "BroadcastHashJoin" in plan and "ReadSchema: struct<p_id:int>" in plan
    assert "SortMergeJoin" not in plan
    assert [r.p_id for r in new.collect()] == [300000]
