"""Registered queries: the eleven questions (Q1–Q13) and the report
over AV, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitlens.operators import questions as Q
from admitlens.operators import report as R
from admitlens.plans.applicants_view import applicants_view, with_av
from admitlens.plans.registry import register


def R2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,15)), 2) AS DOUBLE)"


def PCT(a: str, b: str) -> str:
    return R2(f"CAST(100.0 AS DOUBLE) * ({a}) / NULLIF({b}, 0)")


TOP = ("({c} ILIKE '%Georgetown%' OR {c} ILIKE '%Massachusetts Institute of Technology%' "
       "OR {c} ILIKE '%MIT%' OR {c} ILIKE '%Stanford%' OR {c} ILIKE '%Carnegie Mellon%')")
Q7 = ("program ILIKE '%Johns Hopkins%' AND program ILIKE '%Computer Science%' "
      "AND degreeType ILIKE '%Master%'")
Q8 = (TOP.format(c="program") + " AND program ILIKE '%Computer Science%' AND degreeType ILIKE "
      "'%PhD%' AND status = 'Accepted' AND semester LIKE '%2026%'")
Q9 = (TOP.format(c="llm_generated_university") + " AND llm_generated_program ILIKE "
      "'%Computer Science%' AND degreeType ILIKE '%PhD%' AND status = 'Accepted' "
      "AND semester LIKE '%2026%'")

SQL_Q10 = f"""SELECT semester, COUNT(*) AS total,
  COUNT(*) FILTER (WHERE status = 'Rejected') AS rejections,
  {PCT("COUNT(*) FILTER (WHERE status = 'Rejected')", "COUNT(*)")} AS rejection_pct
FROM av WHERE degreeType ILIKE '%PhD%' AND (semester LIKE '%2026%' OR semester LIKE '%2025%')
GROUP BY semester ORDER BY semester DESC NULLS FIRST LIMIT 100"""
SQL_Q11 = f"""SELECT status, COUNT(*) AS total, {R2("AVG(gpa)")} AS avg_gpa
FROM av WHERE degreeType ILIKE '%PhD%' AND semester LIKE '%2026%'
  AND status IN ('Accepted', 'Rejected') AND gpa IS NOT NULL
GROUP BY status ORDER BY status LIMIT 100"""
SQL_BUNDLE = f"""SELECT
  COUNT(*) FILTER (WHERE semester = 'Fall 2026') AS q1_total,
  {PCT("COUNT(*) FILTER (WHERE citizenship = 'International')", "COUNT(*)")} AS q2_international_pct,
  {R2("AVG(gpa)")} AS q3_avg_gpa, {R2("AVG(gre)")} AS q3_avg_gre,
  {R2("AVG(gre_v)")} AS q3_avg_gre_v, {R2("AVG(gre_aw)")} AS q3_avg_gre_aw,
  {R2("AVG(gpa) FILTER (WHERE semester = 'Fall 2026' AND citizenship = 'American')")} AS q4_avg_gpa,
  {PCT("COUNT(*) FILTER (WHERE semester = 'Fall 2026' AND status = 'Accepted')",
       "COUNT(*) FILTER (WHERE semester = 'Fall 2026')")} AS q5_acceptance_pct,
  {R2("AVG(gpa) FILTER (WHERE semester = 'Fall 2026' AND status = 'Accepted')")} AS q6_avg_gpa,
  COUNT(*) FILTER (WHERE {Q7}) AS q7_total,
  COUNT(*) FILTER (WHERE {Q8}) AS q8_total,
  COUNT(*) FILTER (WHERE {Q9}) AS q9_total
FROM av"""

_SCALARS = " UNION ALL ".join(
    f"SELECT '{q}' AS question, 1 AS row_no, CAST(NULL AS VARCHAR) AS label, '{m}' AS metric, "
    f"CAST({q}_{m} AS DOUBLE) AS value FROM bundle" for q, m in Q.SCALAR_COLUMNS)
SQL_LONG = f"""WITH av_rec AS (SELECT 1), bundle AS ({SQL_BUNDLE}),
q10 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY semester DESC) AS row_no FROM ({SQL_Q10}) t),
q11 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY status) AS row_no FROM ({SQL_Q11}) t),
answers AS (
{_SCALARS}
UNION ALL SELECT 'q10', row_no, semester, 'total', CAST(total AS DOUBLE) FROM q10
UNION ALL SELECT 'q10', row_no, semester, 'rejections', CAST(rejections AS DOUBLE) FROM q10
UNION ALL SELECT 'q10', row_no, semester, 'rejection_pct', rejection_pct FROM q10
UNION ALL SELECT 'q11', row_no, status, 'total', CAST(total AS DOUBLE) FROM q11
UNION ALL SELECT 'q11', row_no, status, 'avg_gpa', avg_gpa FROM q11)"""


def _long_ctes() -> str:
    return SQL_LONG.replace("WITH av_rec AS (SELECT 1), ", ", ")


def _av(spark, sf):
    return applicants_view(spark, sf)


@register("term_count", with_av("SELECT COUNT(*) AS total FROM av WHERE semester = 'Fall 2026'"))
def q_term_count(spark, sf):
    return Q.term_count(_av(spark, sf))


@register("citizenship_pct", with_av(
    "SELECT " + PCT("COUNT(*) FILTER (WHERE citizenship = 'International')", "COUNT(*)")
    + " AS international_pct FROM av"))
def q_citizenship_pct(spark, sf):
    return Q.citizenship_pct(_av(spark, sf))


@register("average_scores", with_av(
    f"SELECT {R2('AVG(gpa)')} AS avg_gpa, {R2('AVG(gre)')} AS avg_gre, "
    f"{R2('AVG(gre_v)')} AS avg_gre_v, {R2('AVG(gre_aw)')} AS avg_gre_aw FROM av "
    "WHERE gpa IS NOT NULL OR gre IS NOT NULL OR gre_v IS NOT NULL OR gre_aw IS NOT NULL"))
def q_average_scores(spark, sf):
    return Q.average_scores(_av(spark, sf))


@register("term_citizen_gpa", with_av(
    f"SELECT {R2('AVG(gpa)')} AS avg_gpa FROM av WHERE citizenship = 'American' "
    "AND semester = 'Fall 2026' AND gpa IS NOT NULL"))
def q_term_citizen_gpa(spark, sf):
    return Q.term_citizen_gpa(_av(spark, sf))


@register("term_acceptance_pct", with_av(
    "SELECT " + PCT("COUNT(*) FILTER (WHERE status = 'Accepted')", "COUNT(*)")
    + " AS acceptance_pct FROM av WHERE semester = 'Fall 2026'"))
def q_term_acceptance_pct(spark, sf):
    return Q.term_acceptance_pct(_av(spark, sf))


@register("term_accepted_gpa", with_av(
    f"SELECT {R2('AVG(gpa)')} AS avg_gpa FROM av WHERE semester = 'Fall 2026' "
    "AND status = 'Accepted' AND gpa IS NOT NULL"))
def q_term_accepted_gpa(spark, sf):
    return Q.term_accepted_gpa(_av(spark, sf))


@register("school_program_degree_count", with_av(f"SELECT COUNT(*) AS total FROM av WHERE {Q7}"))
def q_school_program_degree_count(spark, sf):
    return Q.school_program_degree_count(_av(spark, sf))


@register("top_school_acceptances", with_av(f"SELECT COUNT(*) AS total FROM av WHERE {Q8}"))
def q_top_school_acceptances(spark, sf):
    return Q.top_school_acceptances(_av(spark, sf))


@register("top_school_acceptances_std", with_av(f"SELECT COUNT(*) AS total FROM av WHERE {Q9}"))
def q_top_school_acceptances_std(spark, sf):
    return Q.top_school_acceptances_std(_av(spark, sf))


@register("rejection_rate_by_term", with_av(SQL_Q10))
def q_rejection_rate_by_term(spark, sf):
    return Q.rejection_rate_by_term(_av(spark, sf))


@register("gpa_by_outcome", with_av(SQL_Q11))
def q_gpa_by_outcome(spark, sf):
    return Q.gpa_by_outcome(_av(spark, sf))


@register("scalar_bundle", with_av(SQL_BUNDLE))
def q_scalar_bundle(spark, sf):
    return Q.scalar_bundle(_av(spark, sf))


@register("run_all", with_av(_long_ctes() + "\nSELECT * FROM answers"))
def q_run_all(spark, sf):
    return Q.run_all(_av(spark, sf))


@register("order_limit", with_av(
    "SELECT semester, COUNT(*) AS total FROM av GROUP BY semester "
    "ORDER BY total DESC, semester LIMIT 5"))
def q_order_limit(spark, sf):
    """R1 as a top-k report: the five largest terms."""
    terms = _av(spark, sf).groupBy("semester").agg(F.count(F.lit(1)).alias("total"))
    return R.order_limit(terms, [F.col("total").desc(), F.col("semester").asc()], 5)


_FMT = """SELECT a.question, a.row_no, t.title, a.label, a.metric,
  CASE WHEN a.value IS NULL AND a.question = 'q3' THEN 'N/A'
       WHEN a.value IS NULL THEN '—'
       WHEN a.metric LIKE '%\\_pct' ESCAPE '\\' THEN printf('%.2f', a.value) || '%'
       WHEN a.metric LIKE 'avg\\_%' ESCAPE '\\' THEN printf('%.2f', a.value)
       WHEN a.question IN ('q10', 'q11') THEN format('{:,}', CAST(a.value AS BIGINT))
       ELSE CAST(CAST(a.value AS BIGINT) AS VARCHAR) END AS text
FROM answers a JOIN (VALUES """ + ", ".join(
    f"('{k}', '{v}')" for k, v in __import__(
        "admitlens.fixed_values", fromlist=["QUESTION_LABELS"]).QUESTION_LABELS.items()
) + ") AS t(question, title) ON a.question = t.question"


@register("format_report", with_av(_long_ctes() + "\n" + _FMT))
def q_format_report(spark, sf):
    return R.format_report(Q.run_all(_av(spark, sf)))


_REPORT_SQL = SQL_LONG.replace("WITH av_rec AS (SELECT 1), ", ", ") + """,
said AS (SELECT question, row_no, label, metric, CASE WHEN value IS NULL THEN 'null'
  WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS v FROM answers),
pieces AS (SELECT question, row_no, CASE question
    WHEN 'q3' THEN '[' || max(v) FILTER (metric = 'avg_gpa') || ',' || max(v) FILTER (metric = 'avg_gre') || ','
      || max(v) FILTER (metric = 'avg_gre_v') || ',' || max(v) FILTER (metric = 'avg_gre_aw') || ']'
    WHEN 'q10' THEN '[' || coalesce(CAST(to_json(label) AS VARCHAR), 'null') || ',' || max(v) FILTER (metric = 'total') || ','
      || max(v) FILTER (metric = 'rejections') || ',' || max(v) FILTER (metric = 'rejection_pct') || ']'
    WHEN 'q11' THEN '[' || coalesce(CAST(to_json(label) AS VARCHAR), 'null') || ',' || max(v) FILTER (metric = 'total') || ','
      || max(v) FILTER (metric = 'avg_gpa') || ']'
    ELSE max(v) END AS piece FROM said GROUP BY question, row_no, label),
bodies AS (SELECT question, CASE WHEN question IN ('q10', 'q11') THEN '[' || string_agg(piece, ',' ORDER BY row_no) || ']'
  ELSE max(piece) END AS body FROM pieces GROUP BY question)
SELECT '{' || string_agg('"' || question || '":' || body, ',' ORDER BY CAST(substr(question, 2) AS INTEGER)) || '}' AS report
FROM bodies"""


@register("report_json", with_av(_REPORT_SQL))
def q_report_json(spark, sf):
    """R3; also parsed back against the answers in the tests."""
    return R.report_json(Q.run_all(_av(spark, sf)))


@register("answer_set", with_av("""
SELECT 'rows' AS question, COUNT(*) AS value FROM av
UNION ALL SELECT 'phd', COUNT(*) FROM av WHERE degreeType = 'PhD'
UNION ALL SELECT 'q1', COUNT(*) FROM av WHERE semester = 'Fall 2026'"""))
def q_answer_set(spark, sf):
    """A question set of the user's own beside one of the eleven."""
    own = {"rows": lambda df: df.agg(F.count(F.lit(1)).alias("value")),
           "phd": lambda df: df.filter(F.col("degreeType") == "PhD").agg(F.count(F.lit(1)).alias("value")),
           "q1": lambda df: Q.term_count(df).toDF("value")}
    answers = [a.select(F.lit(name).alias("question"), "value") for name, a in Q.answer_set(_av(spark, sf), own).items()]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])
