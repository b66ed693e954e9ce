"""The eleven questions on an applicants DataFrame, parameterised.

Each single question filters first (so equality / IN / null predicates reach
the parquet scan) and then aggregates with partial + final HashAggregate.
``scalar_bundle`` answers Q1–Q9 in one scan with conditional aggregates, and
``run_all`` answers all from one scan into mergeable cells, which a table keeps per
batch.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from admitlens.fixed_values import (
    DEFAULT_LIMIT,
    MAX_LIMIT,
    DEFAULT_TERM,
    DEFAULT_YEARS,
    TOP_SCHOOL_PATTERNS,
)
from admitlens.functions.numbers import clamp_limit, pct, round2
from admitlens.session import store
from admitlens.sources.tables import BATCH_COL


def _any_ilike(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.ilike(p) for p in patterns])


def _any_like(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.like(p) for p in patterns])


# ------------------------------------------------------------ predicates
def _term(df: DataFrame, term: str) -> Column:
    """semester = term; on a table partitioned by term year the implied
    ``term_year`` predicate is added so only that partition is read."""
    cond = F.col("semester") == term
    m = re.search(r"(\d{4})", term)
    if m and "term_year" in df.columns:
        cond = cond & (F.col("term_year") == int(m.group(1)))
    return cond


def _q7_pred(school="%Johns Hopkins%", program="%Computer Science%", degree="%Master%"):
    return (F.col("program").ilike(school) & F.col("program").ilike(program)
            & F.col("degreeType").ilike(degree))


def _q8_pred(school_col="program", program_col="program", schools=None,
             program="%Computer Science%", degree="%PhD%", status="Accepted", year="2026"):
    schools = schools or TOP_SCHOOL_PATTERNS
    return (_any_ilike(F.col(school_col), schools) & F.col(program_col).ilike(program)
            & F.col("degreeType").ilike(degree) & (F.col("status") == status)
            & F.col("semester").like(f"%{year}%"))


# ------------------------------------------------------------ Q1 .. Q11
def term_count(df: DataFrame, term: str = DEFAULT_TERM) -> DataFrame:
    """Q1: rows of one term."""
    return df.filter(_term(df, term)).agg(F.count(F.lit(1)).alias("total"))


def citizenship_pct(df: DataFrame, citizenship: str = "International") -> DataFrame:
    """Q2: 100 * rows of a citizenship / all rows, 2 dp (NULL on no rows)."""
    return df.agg(pct(F.count_if(F.col("citizenship") == citizenship), F.count(F.lit(1)))
                  .alias("international_pct"))


def average_scores(df: DataFrame) -> DataFrame:
    """Q3: the four score averages over rows having any score."""
    any_score = (F.col("gpa").isNotNull() | F.col("gre").isNotNull()
                 | F.col("gre_v").isNotNull() | F.col("gre_aw").isNotNull())
    return df.filter(any_score).agg(
        round2(F.avg("gpa")).alias("avg_gpa"),
        round2(F.avg("gre")).alias("avg_gre"),
        round2(F.avg("gre_v")).alias("avg_gre_v"),
        round2(F.avg("gre_aw")).alias("avg_gre_aw"),
    )


def term_citizen_gpa(df: DataFrame, term: str = DEFAULT_TERM,
                     citizenship: str = "American") -> DataFrame:
    """Q4: average GPA of one citizenship in one term."""
    return (df.filter((F.col("citizenship") == citizenship) & _term(df, term)
                      & F.col("gpa").isNotNull())
            .agg(round2(F.avg("gpa")).alias("avg_gpa")))


def term_acceptance_pct(df: DataFrame, term: str = DEFAULT_TERM,
                        status: str = "Accepted") -> DataFrame:
    """Q5: 100 * accepted / all within a term."""
    return (df.filter(_term(df, term))
            .agg(pct(F.count_if(F.col("status") == status), F.count(F.lit(1)))
                 .alias("acceptance_pct")))


def term_accepted_gpa(df: DataFrame, term: str = DEFAULT_TERM,
                      status: str = "Accepted") -> DataFrame:
    """Q6: average GPA of the accepted in a term."""
    return (df.filter(_term(df, term) & (F.col("status") == status)
                      & F.col("gpa").isNotNull())
            .agg(round2(F.avg("gpa")).alias("avg_gpa")))


def school_program_degree_count(df: DataFrame, school: str = "%Johns Hopkins%",
                                program: str = "%Computer Science%",
                                degree: str = "%Master%") -> DataFrame:
    """Q7: rows matching three case-free patterns."""
    return df.filter(_q7_pred(school, program, degree)).agg(F.count(F.lit(1)).alias("total"))


def top_school_acceptances(df: DataFrame, schools: list[str] | None = None,
                           year: str = "2026") -> DataFrame:
    """Q8: accepted PhD CS rows of a year at any of the listed schools."""
    return df.filter(_q8_pred(schools=schools, year=year)).agg(
        F.count(F.lit(1)).alias("total"))


def top_school_acceptances_std(df: DataFrame, schools: list[str] | None = None,
                               year: str = "2026") -> DataFrame:
    """Q9: Q8 on the standardised program/university columns."""
    return df.filter(_q8_pred("llm_generated_university", "llm_generated_program",
                              schools=schools, year=year)).agg(
        F.count(F.lit(1)).alias("total"))


def rejection_rate_by_term(df: DataFrame, years: list[str] | None = None,
                           degree: str = "%PhD%", status: str = "Rejected",
                           limit=DEFAULT_LIMIT, max_limit: int | None = MAX_LIMIT) -> DataFrame:
    """Q10: per term: total, rejections, pct; term descending; capped at
    ``limit``, itself at most ``max_limit`` (None: no ceiling)."""
    years = years or DEFAULT_YEARS
    return (df.filter(F.col("degreeType").ilike(degree)
                      & _any_like(F.col("semester"), [f"%{y}%" for y in years]))
            .groupBy("semester")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("status") == status).alias("rejections"))
            .withColumn("rejection_pct", pct(F.col("rejections"), F.col("total")))
            .orderBy(F.col("semester").desc_nulls_first())
            .limit(clamp_limit(limit, max_limit)))


def gpa_by_outcome(df: DataFrame, year: str = "2026", degree: str = "%PhD%",
                   statuses: tuple[str, ...] = ("Accepted", "Rejected"),
                   limit=DEFAULT_LIMIT, max_limit: int | None = MAX_LIMIT) -> DataFrame:
    """Q11: per status: count and average GPA of rows with a GPA; capped at
    ``limit``, itself at most ``max_limit`` (None: no ceiling)."""
    return (df.filter(F.col("degreeType").ilike(degree) & F.col("semester").like(f"%{year}%")
                      & F.col("status").isin(*statuses) & F.col("gpa").isNotNull())
            .groupBy("status")
            .agg(F.count(F.lit(1)).alias("total"), round2(F.avg("gpa")).alias("avg_gpa"))
            .orderBy(F.col("status").asc_nulls_last())
            .limit(clamp_limit(limit, max_limit)))


# ------------------------------------------------------------ Q12 / Q13
SCALAR_COLUMNS = [
    ("q1", "total"), ("q2", "international_pct"), ("q3", "avg_gpa"), ("q3", "avg_gre"),
    ("q3", "avg_gre_v"), ("q3", "avg_gre_aw"), ("q4", "avg_gpa"), ("q5", "acceptance_pct"),
    ("q6", "avg_gpa"), ("q7", "total"), ("q8", "total"), ("q9", "total"),
]


def scalar_bundle(df: DataFrame, term: str = DEFAULT_TERM) -> DataFrame:
    """Q12: Q1–Q9 in one scan: a single aggregate of conditional aggregates."""
    sem = F.col("semester") == term
    gpa = F.col("gpa")
    in_term = F.count_if(sem)
    return df.agg(
        in_term.alias("q1_total"),
        pct(F.count_if(F.col("citizenship") == "International"), F.count(F.lit(1)))
        .alias("q2_international_pct"),
        round2(F.avg("gpa")).alias("q3_avg_gpa"),
        round2(F.avg("gre")).alias("q3_avg_gre"),
        round2(F.avg("gre_v")).alias("q3_avg_gre_v"),
        round2(F.avg("gre_aw")).alias("q3_avg_gre_aw"),
        round2(F.avg(F.when(sem & (F.col("citizenship") == "American"), gpa)))
        .alias("q4_avg_gpa"),
        pct(F.count_if(sem & (F.col("status") == "Accepted")), in_term)
        .alias("q5_acceptance_pct"),
        round2(F.avg(F.when(sem & (F.col("status") == "Accepted"), gpa))).alias("q6_avg_gpa"),
        F.count_if(_q7_pred()).alias("q7_total"),
        F.count_if(_q8_pred()).alias("q8_total"),
        F.count_if(_q8_pred("llm_generated_university", "llm_generated_program"))
        .alias("q9_total"),
    )


# Measures whose count and sum a cell holds, and the patterns it counts rows by.
MEASURES = ("gpa", "gre", "gre_v", "gre_aw")
CELL_KEYS = ("semester", "status", "citizenship", "phd", "q7", "q8", "q9")


def answer_cells(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Mergeable partial aggregates for Q1–Q11: rows, and count and sum of each score,
    per semester, status, citizenship and pattern flag (and the columns ``keep``). One
    scan; cells of parts of a table add up to those of the whole."""
    flags = {"phd": F.col("degreeType").ilike("%PhD%"), "q7": _q7_pred(), "q8": _q8_pred(),
             "q9": _q8_pred("llm_generated_university", "llm_generated_program")}
    rows = df.select(*(keep or []), "semester", "status", "citizenship",
                     *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()], *MEASURES)
    return rows.groupBy(*(keep or []), *CELL_KEYS).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(m).alias(f"{m}_n") for m in MEASURES],
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(f"{m}_sum") for m in MEASURES])


def _mean(measure: str, where: Column | None = None) -> Column:
    def total(c: str) -> Column:
        return F.sum(F.col(c) if where is None else F.when(where, F.col(c)))

    return round2(total(f"{measure}_sum") / F.nullif(total(f"{measure}_n"), F.lit(0)))


def answers_of(cells: DataFrame, term: str = DEFAULT_TERM, limit=DEFAULT_LIMIT,
               max_limit: int | None = MAX_LIMIT) -> DataFrame:
    """Q13 from ``answer_cells``, which may hold several rows for a cell. Pass a stored
    frame: it is read three times."""
    def rows(where: Column | None = None) -> Column:
        n = F.sum(F.col("n") if where is None else F.when(where, F.col("n")))
        return F.coalesce(n, F.lit(0)).cast("long")

    sem, accepted = F.col("semester") == term, F.col("status") == "Accepted"
    scalars = {
        ("q1", "total"): rows(sem),
        ("q2", "international_pct"): pct(rows(F.col("citizenship") == "International"), rows()),
        **{("q3", f"avg_{m}"): _mean(m) for m in MEASURES},
        ("q4", "avg_gpa"): _mean("gpa", sem & (F.col("citizenship") == "American")),
        ("q5", "acceptance_pct"): pct(rows(sem & accepted), rows(sem)),
        ("q6", "avg_gpa"): _mean("gpa", sem & accepted),
        **{(q, "total"): rows(F.col(q)) for q in ("q7", "q8", "q9")},
    }
    bundle = cells.agg(*[e.alias(f"{q}_{m}") for (q, m), e in scalars.items()])
    stack = ", ".join(f"'{q}', '{m}', CAST(`{q}_{m}` AS DOUBLE)" for q, m in SCALAR_COLUMNS)
    scalar_long = bundle.selectExpr(f"stack({len(SCALAR_COLUMNS)}, {stack}) AS (question, metric, value)") \
        .select("question", F.lit(1).cast("long").alias("row_no"),
                F.lit(None).cast("string").alias("label"), "metric", "value")
    # A row per term or status at most from here on.
    q10 = (cells.filter(F.col("phd") & _any_like(F.col("semester"), [f"%{y}%" for y in DEFAULT_YEARS]))
           .groupBy("semester").agg(rows().alias("total"), rows(F.col("status") == "Rejected").alias("rejections"))
           .withColumn("rejection_pct", pct(F.col("rejections"), F.col("total")))
           .orderBy(F.col("semester").desc_nulls_first()).limit(clamp_limit(limit, max_limit)))
    q10 = q10.withColumn("row_no", F.row_number().over(Window.orderBy(F.col("semester").desc_nulls_first())).cast("long"))
    q10_long = q10.selectExpr(
        "'q10' AS question", "row_no", "semester AS label",
        "stack(3, 'total', CAST(total AS DOUBLE), 'rejections', CAST(rejections AS DOUBLE), "
        "'rejection_pct', rejection_pct) AS (metric, value)")
    q11 = (cells.filter(F.col("phd") & F.col("semester").like("%2026%") & F.col("status").isin("Accepted", "Rejected")
                        & (F.col("gpa_n") > 0))
           .groupBy("status").agg(F.sum("gpa_n").alias("total"), _mean("gpa").alias("avg_gpa"))
           .orderBy(F.col("status").asc_nulls_last()).limit(clamp_limit(limit, max_limit)))
    q11 = q11.withColumn("row_no", F.row_number().over(Window.orderBy("status")).cast("long"))
    q11_long = q11.selectExpr(
        "'q11' AS question", "row_no", "status AS label",
        "stack(2, 'total', CAST(total AS DOUBLE), 'avg_gpa', avg_gpa) AS (metric, value)")
    return scalar_long.unionByName(q10_long).unionByName(q11_long)


def run_all(df: DataFrame, limit=DEFAULT_LIMIT, max_limit: int | None = MAX_LIMIT) -> DataFrame:
    """Q13: every answer as one long frame (question, row_no, label, metric, value), from
    one scan: the cells are stored, and all answers come from merging them."""
    return answers_of(store(answer_cells(df), "cells"), limit=limit, max_limit=max_limit)


def refreshed_answers(table) -> DataFrame:
    """Q13 of a table that grows by batches: cells are kept beside each committed batch,
    so only batches without cells are scanned; a batch's cells replace themselves."""
    missing = [i for i in table.commits.ids() if not table.commits.exists(table.cells_folder(i))]
    if missing:
        cells = store(answer_cells(table.scan_batches(missing), keep=[BATCH_COL]), "cells")
        for i in missing:
            cells.where(F.col(BATCH_COL) == i).drop(BATCH_COL).write.mode("overwrite").parquet(table.cells_folder(i))
    cells = table.cells()
    return run_all(table.scan()) if cells is None else answers_of(cells)


QUESTIONS = {
    "q1": term_count, "q2": citizenship_pct, "q3": average_scores, "q4": term_citizen_gpa,
    "q5": term_acceptance_pct, "q6": term_accepted_gpa, "q7": school_program_degree_count,
    "q8": top_school_acceptances, "q9": top_school_acceptances_std,
    "q10": rejection_rate_by_term, "q11": gpa_by_outcome,
}


def answer_set(df: DataFrame, questions=None) -> dict[str, DataFrame]:
    """A replaceable question set: name -> (applicants DataFrame -> answer
    DataFrame). Defaults to the eleven questions."""
    return {name: fn(df) for name, fn in (questions or QUESTIONS).items()}


def answer_until_failure(df: DataFrame, questions=None) -> tuple[dict[str, list], str | None]:
    """Q13, strict: the questions one after the other; the first that fails ends
    it. Returns the answers given so far (rows of each tiny answer frame) and
    which question failed why, or None."""
    done: dict[str, list] = {}
    for name, fn in (questions or QUESTIONS).items():
        try:
            done[name] = [tuple(r) for r in fn(df).collect()]
        except Exception as e:  # noqa: BLE001 - reported, with what was computed before
            return done, f"{name}: {type(e).__name__}: {e}"
    return done, None
