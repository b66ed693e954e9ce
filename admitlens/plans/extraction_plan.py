"""Registered queries: extraction (E1–E11, S8) on the driver's ``pages`` and
on listing pages rendered from AV."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from admitlens.functions.records import classify_badges, parse_prefixed_number, resolve_url
from admitlens.functions.records import split_status_date
from admitlens.operators import extract as E
from admitlens.plans.applicants_view import applicant_records, with_av
from admitlens.plans.listing import BASE_URL, PAGE_SPAN, render_listing
from admitlens.plans.registry import register
from admitlens.session import read_table


def _listing(spark, sf):
    return render_listing(applicant_records(spark, sf))


# Expected listing content, from AV (oracle side).
LST = f"""lst AS (SELECT p_id, CAST(floor(p_id / {PAGE_SPAN}) AS BIGINT) AS page_id, university,
  raw_program, degreeType, datePosted, status, semester, citizenship, gpa, gre, gre_v, gre_aw, url
  FROM av_rec),
rec AS (SELECT *, CAST(COALESCE(SUM(CASE WHEN p_id % 4 = 0 THEN 3 ELSE 2 END) OVER (
  PARTITION BY page_id ORDER BY p_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS INTEGER) AS s,
  CAST(ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY p_id) - 1 AS INTEGER) AS record_no
  FROM lst)"""


def lst_sql(body: str) -> str:
    return with_av(", " + LST + "\n" + body)


A_ITEMS = """x AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs,
  regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts FROM pages),
a AS (SELECT page_id, url, CAST(unnest(generate_series(0, len(hrefs) - 1)) AS INTEGER) AS pos,
  unnest(hrefs) AS href, unnest(texts) AS text FROM x)"""


# ----------------------------------------------------------------- E1
@register("explode_elements", f"WITH {A_ITEMS} SELECT page_id, pos, href, text FROM a")
def q_explode_elements(spark, sf):
    el = E.explode_elements(read_table(spark, sf, "pages"), "a", with_descendants=False)
    return el.filter(F.col("pos") >= 0).select("page_id", "pos", "href", "text")


# ----------------------------------------------------------------- E2 / E3
@register("mark_record_start", lst_sql("""
SELECT page_id, s AS pos, true AS is_start FROM rec
UNION ALL SELECT page_id, s + 1, false FROM rec
UNION ALL SELECT page_id, s + 2, false FROM rec WHERE p_id % 4 = 0"""))
def q_mark_record_start(spark, sf):
    rows = E.mark_record_start(E.explode_elements(_listing(spark, sf), "tr"))
    return rows.select("page_id", "pos", "is_start")


@register("main_row_fields", lst_sql("""
SELECT page_id, s AS pos, university, raw_program AS program, degreeType AS degree_type,
  strftime(datePosted, '%b %-d, %Y') AS date_posted, status,
  CASE WHEN p_id % 3 = 0 THEN strftime(datePosted + INTERVAL 30 DAY, '%-d %b') END AS status_date,
  url FROM rec"""))
def q_main_row_fields(spark, sf):
    rows = E.mark_record_start(E.explode_elements(_listing(spark, sf), "tr")).filter("is_start")
    return E.main_row_fields(rows, BASE_URL).select(
        "page_id", "pos", "university", "program", "degree_type", "date_posted", "status",
        "status_date", "url")


# ----------------------------------------------------------------- E4
@register("stitch_followers", """
WITH x AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)
  AS items FROM pages),
y AS (SELECT page_id, CAST(unnest(generate_series(0, len(items) - 1)) AS INTEGER) AS pos,
  unnest(items) AS text FROM x)
SELECT page_id, pos, text,
  lead(text, 1) OVER (PARTITION BY page_id ORDER BY pos) AS next_text,
  lead(text, 2) OVER (PARTITION BY page_id ORDER BY pos) AS next2_text
FROM y""")
def q_stitch_followers(spark, sf):
    li = E.stitch_followers(E.page_elements(read_table(spark, sf, "pages"), "li", with_descendants=False))
    return li.filter(F.col("pos") >= 0).select(
        "page_id", "pos", "text", F.col("next.text").alias("next_text"), F.col("next2.text").alias("next2_text"))


# ----------------------------------------------------------------- E5
@register("split_status_date", with_av("""
, t AS (SELECT p_id, CASE WHEN p_id % 5 = 0 THEN '  ' || status || ' on  1 Mar on x '
    WHEN p_id % 3 = 0 THEN status || ' on ' || strftime(datePosted, '%-d %b')
    ELSE status END AS txt FROM av_rec)
SELECT p_id, CASE WHEN strpos(txt, ' on ') > 0 THEN trim(left(txt, strpos(txt, ' on ') - 1))
  ELSE txt END AS status,
  CASE WHEN strpos(txt, ' on ') > 0 THEN trim(substr(txt, strpos(txt, ' on ') + 4)) END
  AS status_date FROM t"""))
def q_split_status_date(spark, sf):
    r = applicant_records(spark, sf)
    k = F.col("p_id")
    txt = (F.when(k % 5 == 0, F.concat(F.lit("  "), F.col("status"), F.lit(" on  1 Mar on x ")))
           .when(k % 3 == 0, F.concat(F.col("status"), F.lit(" on "),
                                      F.date_format("datePosted", "d MMM")))
           .otherwise(F.col("status")))
    return r.select("p_id", split_status_date(txt).alias("s")).select("p_id", "s.*")


# ----------------------------------------------------------------- E6
@register("resolve_url", f"""WITH {A_ITEMS}
SELECT page_id, pos, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href
  AS resolved FROM a""")
def q_resolve_url(spark, sf):
    el = E.explode_elements(read_table(spark, sf, "pages"), "a", with_descendants=False,
                            carry=["url"]).filter(F.col("pos") >= 0)
    return el.select("page_id", "pos", resolve_url(F.col("url"), F.col("href")).alias("resolved"))


# ----------------------------------------------------------------- E7 / E8
@register("classify_badges", with_av("""
SELECT p_id, semester, citizenship,
  CASE WHEN p_id % 5 = 0 THEN 4.0 ELSE gpa END AS gpa,
  CASE WHEN p_id % 11 = 0 THEN NULL ELSE gre END AS gre, gre_v, gre_aw FROM av_rec"""))
def q_classify_badges(spark, sf):
    r = applicant_records(spark, sf)
    k = F.col("p_id")
    badges = F.filter(F.array(
        F.col("semester"), F.col("citizenship"),
        F.concat(F.lit("GPA "), F.col("gpa").cast("string")),
        F.concat(F.lit("GRE "), F.col("gre").cast("int").cast("string")),
        F.concat(F.lit("GRE V "), F.col("gre_v").cast("int").cast("string")),
        F.concat(F.lit("GRE AW "), F.col("gre_aw").cast("string")),
        F.when(k % 5 == 0, F.lit("GPA 4.0")),
        F.when(k % 11 == 0, F.lit("GRE (not given)"))), lambda x: x.isNotNull())
    return r.select("p_id", classify_badges(badges).alias("b")).select("p_id", "b.*")


@register("parse_prefixed_number", with_av("""
SELECT p_id, CASE WHEN p_id % 4 = 3 THEN NULL ELSE gpa END AS gpa FROM av_rec"""))
def q_parse_prefixed_number(spark, sf):
    r = applicant_records(spark, sf)
    k = F.col("p_id")
    g = F.col("gpa").cast("string")
    txt = (F.when(k % 4 == 0, F.concat(F.lit("GPA "), g))
           .when(k % 4 == 1, F.concat(F.lit("  GPA"), g, F.lit("\t")))
           .when(k % 4 == 2, F.concat(F.lit("GPA GPA "), g))
           .otherwise(F.lit("GPA nan")))
    return r.select("p_id", parse_prefixed_number(txt, "GPA").alias("gpa"))


# ----------------------------------------------------------------- E9 / E10 / E11 / S8
@register("extract_comment", lst_sql("""
SELECT page_id, record_no, CASE WHEN p_id % 4 = 0 THEN 'Notep' || CAST(p_id AS VARCHAR) || 'pok'
  END AS comment FROM rec"""))
def q_extract_comment(spark, sf):
    recs = E.extract_listing(_listing(spark, sf), BASE_URL, comment_separator="p")
    return recs.select("page_id", "record_no", "comment")


_EXPECTED = """
SELECT page_id, record_no, university, raw_program AS program, degreeType AS degree_type,
  strftime(datePosted, '%b %-d, %Y') AS date_posted, status,
  CASE WHEN p_id % 3 = 0 THEN strftime(datePosted + INTERVAL 30 DAY, '%-d %b') END AS status_date,
  semester, citizenship, CASE WHEN p_id % 7 = 0 THEN NULL ELSE gpa END AS gpa, gre, gre_v, gre_aw,
  CASE WHEN p_id % 4 = 0 THEN 'Note ' || CAST(p_id AS VARCHAR) || ' ok' END AS comment, url,
  CASE WHEN p_id % 7 = 0 THEN 1 ELSE 0 END AS bad_fields
FROM rec"""


@register("extract_listing", lst_sql(_EXPECTED))
def q_extract_listing(spark, sf):
    return E.extract_listing(_listing(spark, sf), BASE_URL)


@register("extraction_issues", lst_sql("""
SELECT page_id, CAST(SUM(CASE WHEN p_id % 4 = 0 THEN 3 ELSE 2 END) AS BIGINT) AS rows,
  COUNT(*) AS records, CAST(SUM(CASE WHEN p_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_fields,
  CAST(NULL AS VARCHAR) AS failure
FROM rec GROUP BY page_id"""))
def q_extraction_issues(spark, sf):
    return E.extraction_issues(_listing(spark, sf), BASE_URL)


@register("scan_pages", lst_sql("""
SELECT page_id, COUNT(*) AS records FROM rec GROUP BY page_id
UNION ALL SELECT -1 - page_id, 0 FROM pages"""))
def q_scan_pages(spark, sf):
    """Listing pages and the raw pages (no records there) in one scan."""
    raw = read_table(spark, sf, "pages").select((F.lit(-1) - F.col("page_id")).alias("page_id"),
                                                "url", "html")
    pages = _listing(spark, sf).unionByName(raw)
    return E.extraction_issues(pages, BASE_URL).select("page_id", "records")
