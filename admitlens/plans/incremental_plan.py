"""Registered queries: incremental pulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitlens.operators import extract as E
from admitlens.operators import incremental as I
from admitlens.plans.applicants_view import applicant_records, with_av
from admitlens.plans.listing import BASE_URL, PAGE_SPAN, render_listing, stored_listing
from admitlens.plans.registry import register
from admitlens.schema import WATERMARKS
from admitlens.session import read_table, store


# ----------------------------------------------------------------- I1
def _pages_urls(spark, sf):
    p = read_table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("url"))
    return p.select("page_id", url.alias("url"))


@register("new_by_url", """
WITH b AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN NULL ELSE url END AS url FROM pages),
k AS (SELECT * FROM b WHERE page_id % 2 = 0)
SELECT page_id, url FROM b WHERE NOT EXISTS (
  SELECT 1 FROM k WHERE k.url IS NOT DISTINCT FROM b.url)""")
def q_new_by_url(spark, sf):
    batch = _pages_urls(spark, sf)
    known = batch.filter(F.col("page_id") % 2 == 0)
    return I.new_by_url(batch, known)


# ----------------------------------------------------------------- I2 / I3
# Known records: every fifth key, plus everything from three quarters of the
# key range on (older listing pages), so that some page is fully seen.
_KNOWN_SQL = "(p_id % 5 = 0 OR p_id >= (SELECT floor(max(p_id) * 3 / 4) FROM av_rec))"


def _known_split(spark, sf):
    r = applicant_records(spark, sf)
    t = r.agg(F.floor(F.max("p_id") * 3 / 4).alias("t")).first()["t"]
    known = (F.col("p_id") % 5 == 0) | (F.col("p_id") >= F.lit(t))
    batch = r.select("p_id", F.floor(F.col("p_id") / PAGE_SPAN).cast("long").alias("page_id"),
                     "url")
    table = r.filter(known).select("p_id", "url")
    return batch, table


@register("page_novelty", with_av(f"""
SELECT CAST(floor(p_id / {PAGE_SPAN}) AS BIGINT) AS page_id,
  COUNT(*) FILTER (WHERE NOT {_KNOWN_SQL}) AS new, COUNT(*) AS total
FROM av_rec GROUP BY 1"""))
def q_page_novelty(spark, sf):
    batch, table = _known_split(spark, sf)
    return I.page_novelty(I.known_flag(batch, table))


_STOP_CTES = f""", b AS (SELECT p_id, CAST(floor(p_id / {PAGE_SPAN}) AS BIGINT) AS page_id, url,
  {_KNOWN_SQL} AS is_known FROM av_rec),
nov AS (SELECT page_id, COUNT(*) FILTER (WHERE NOT is_known) AS new, COUNT(*) AS total
  FROM b GROUP BY page_id),
stop AS (SELECT min(page_id) FILTER (WHERE total > 0 AND new = 0) AS s FROM nov)"""


@register("stop_at_seen_page", with_av(_STOP_CTES + """
SELECT p_id, page_id, url FROM b WHERE (SELECT s FROM stop) IS NULL OR page_id < (SELECT s FROM stop)"""))
def q_stop_at_seen_page(spark, sf):
    batch, table = _known_split(spark, sf)
    flagged = I.known_flag(batch, table)
    return I.stop_at_seen_page(flagged, I.page_novelty(flagged)).select("p_id", "page_id", "url")


# ----------------------------------------------------------------- I4
@register("number_rows", """
SELECT o_orderkey, CAST((SELECT greatest(COUNT(*), max(c_custkey)) FROM customer)
  + ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS p_id FROM orders""")
def q_number_rows(spark, sf):
    start = I.next_key(read_table(spark, sf, "customer"), "c_custkey")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return I.number_rows(o, ["o_orderdate", "o_orderkey"], start).select("o_orderkey", "p_id")


# ----------------------------------------------------------------- I5
@register("advance_watermark", """
SELECT event_type AS source, CAST(arg_max(event_id, ts) AS VARCHAR) AS last_seen,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM events GROUP BY event_type""")
def q_advance_watermark(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "ts", "event_type")
    median = ev.agg(F.percentile_approx("ts", 0.5).alias("m")).first()["m"]
    empty = spark.createDataFrame([], WATERMARKS)
    old = I.advance_watermark(empty, ev.filter(F.col("ts") < F.lit(median)), "event_type",
                              "event_id", "ts")
    new = I.advance_watermark(old, ev.filter(F.col("ts") >= F.lit(median)), "event_type",
                              "event_id", "ts")
    return new.select("source", "last_seen",
                      F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


# ----------------------------------------------------------------- I6 / I7
def _extracted(spark, sf):
    return E.extract_listing(render_listing(applicant_records(spark, sf)), BASE_URL)


@register("incremental_update", with_av(_STOP_CTES + """,
tab AS (SELECT p_id, url FROM b WHERE is_known),
fresh AS (SELECT url, ROW_NUMBER() OVER (ORDER BY page_id, p_id) AS rn FROM b
  WHERE NOT is_known AND ((SELECT s FROM stop) IS NULL OR page_id < (SELECT s FROM stop)))
SELECT p_id, url FROM tab
UNION ALL
SELECT CAST((SELECT greatest(COUNT(*), max(p_id)) FROM tab) + rn AS BIGINT), url FROM fresh"""))
def q_incremental_update(spark, sf):
    """Second round over the listing: the table holds the known records; the
    update appends the new ones of the pages before the first seen page."""
    # Each wave asks the table: stored, as a table is, not worked out again each time.
    table = store(_known_split(spark, sf)[1], "table")
    pages = stored_listing(render_listing(applicant_records(spark, sf)))
    new = I.incremental_pull(pages, lambda some: E.extract_listing(some, BASE_URL), table)
    return table.unionByName(new.select(F.col("p_id").cast("bigint"), "url"))


@register("full_build", with_av("""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY p_id) AS BIGINT) AS p_id, url FROM av_rec"""))
def q_full_build(spark, sf):
    return I.full_build(_extracted(spark, sf)).select("p_id", "url")
