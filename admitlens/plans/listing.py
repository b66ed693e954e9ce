"""Listing pages rendered from AV records (the extraction round-trip fixture).

Records go to page floor(p_id / 80) (about 20 per page at every scale, since
order keys are a quarter dense); each record is a main row, a badge row and,
for every fourth key, a comment row. Rendering is a grouped aggregation per
page, bounded by the page size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.session import store

PAGE_SPAN = 80
BASE_URL = "https://example.test/"
RENDERED = ["p_id", "university", "raw_program", "degreeType", "datePosted", "status", "semester", "citizenship",
            "gpa", "gre", "gre_v", "gre_aw"]


def _div(cls: str, content: Column) -> Column:
    return F.concat(F.lit(f'<div class="{cls}">\n  '), content, F.lit("\n</div>"))


def _badge(text: Column) -> Column:
    return F.when(text.isNotNull(), _div("tw-inline-flex tw-items-center", text)).otherwise("")


def record_rows(records: DataFrame) -> DataFrame:
    """One HTML fragment (2 or 3 <tr>) per record, with its page."""
    k = F.col("p_id")
    status = F.concat(F.coalesce(F.col("status"), F.lit("")),
                      F.when(k % 3 == 0, F.concat(F.lit(" on "),
                             F.date_format(F.date_add("datePosted", 30), "d MMM")))
                      .otherwise(F.lit("")))
    main = F.concat(
        F.lit("<tr><td>"), _div("tw-font-medium tw-text-gray-900 tw-text-sm", F.col("university")),
        F.lit("</td>\n<td><span>"), F.col("raw_program"), F.lit("</span> <span>"),
        F.col("degreeType"), F.lit("</span></td>\n<td>"),
        F.date_format("datePosted", "MMM d, yyyy"), F.lit("</td>\n<td> "), status,
        F.lit(" </td>\n<td><a href=\"/result/"), k.cast("string"),
        F.lit("\">See more</a></td></tr>\n"))
    gpa = F.when(k % 7 == 0, F.lit("GPA n/a")).when(
        F.col("gpa").isNotNull(), F.concat(F.lit("GPA "), F.col("gpa").cast("string")))
    badges = F.concat(
        F.lit('<tr class="tw-border-none"><td colspan="5">'),
        _badge(F.col("semester")), _badge(F.col("citizenship")), _badge(gpa),
        _badge(F.concat(F.lit("GRE "), F.col("gre").cast("int").cast("string"))),
        _badge(F.concat(F.lit("GRE V "), F.col("gre_v").cast("int").cast("string"))),
        _badge(F.concat(F.lit("GRE AW "), F.col("gre_aw").cast("string"))),
        F.lit("</td></tr>\n"))
    comment = F.when(k % 4 == 0, F.concat(
        F.lit('<tr class="tw-border-none"><td colspan="5"><p>Note <b>'), k.cast("string"),
        F.lit("</b> ok</p></td></tr>\n"))).otherwise(F.lit(""))
    return records.select(F.floor(k / PAGE_SPAN).cast("long").alias("page_id"), k,
                          F.concat(main, badges, comment).alias("fragment"))


def render_listing(records: DataFrame) -> DataFrame:
    """DataFrame(page_id, url, html) of listing pages."""
    # Records are brought together before they become text, which is far wider. AQE would
    # size tasks by these bytes and leave few for the parse; a given number it keeps.
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = records.select(*RENDERED).repartition(parts, F.floor(F.col("p_id") / PAGE_SPAN).cast("long"))
    frags = record_rows(together)
    pages = frags.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("p_id", "fragment"))).alias("f"))
    html = F.concat(F.lit("<!DOCTYPE html><html><body><table><tbody>\n"),
                    F.array_join(F.col("f.fragment"), ""),
                    F.lit("</tbody></table></body></html>"))
    out = pages.select("page_id", F.concat(F.lit(BASE_URL + "survey/?page="),
                                           F.col("page_id").cast("string")).alias("url"),
                       html.alias("html"))
    return out


def stored_listing(pages: DataFrame) -> DataFrame:
    """The pages as a table of files by page id, as a page store has them: a range of
    pages lies in few files, and many tasks parse a wide one."""
    parts = 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(pages.repartitionByRange(parts, "page_id"), "pages")
