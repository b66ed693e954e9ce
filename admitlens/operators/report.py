"""Ranked cut, formatted report, JSON document.

All three work on the tiny answer frames produced by the questions; nothing
here touches the applicants table again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.fixed_values import MISSING_SCORE_TEXT, MISSING_TEXT, QUESTION_LABELS
from admitlens.functions.numbers import clamp_limit


def order_limit(df: DataFrame, order: list[Column], limit) -> DataFrame:
    """Sort then cut (top-k): a TakeOrderedAndProject (per-partition top-k,
    then a merge). The caller's limit stands as given; at least 1."""
    return df.orderBy(*order).limit(clamp_limit(limit, None))


def _label_map() -> Column:
    items = []
    for k, v in QUESTION_LABELS.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def format_report(answers: DataFrame) -> DataFrame:
    """R2: one text per answer value: 2-decimal percents with '%', thousands
    separators on the grouped counts, plain integers for the single counts,
    '—' for a missing value ('N/A' for a missing Q3 score)."""
    q, m, v = F.col("question"), F.col("metric"), F.col("value")
    grouped = q.isin("q10", "q11")
    text = (
        F.when(v.isNull() & (q == "q3"), F.lit(MISSING_SCORE_TEXT))
        .when(v.isNull(), F.lit(MISSING_TEXT))
        .when(m.endswith("_pct"), F.format_string("%.2f%%", v))
        .when(m.startswith("avg_"), F.format_string("%.2f", v))
        .when(grouped, F.format_number(v, 0))
        .otherwise(v.cast("bigint").cast("string"))
    )
    return answers.select(
        "question", "row_no", F.element_at(_label_map(), q).alias("title"),
        "label", "metric", text.alias("text"))


def report_json(answers: DataFrame) -> DataFrame:
    """All answers as one JSON document (one row, column ``report``);
    scalars as numbers, Q3 as a 4-array, Q10/Q11 as arrays of row arrays,
    NULL kept as null."""
    q, m, v = F.col("question"), F.col("metric"), F.col("value")

    def num(c: Column) -> Column:
        return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit("null"))

    # One row per answer row first (tiny frame), then one document.
    rows = answers.groupBy("question", "row_no", "label").agg(
        F.map_from_entries(F.collect_list(F.struct(m, v))).alias("vals"))
    vals = F.col("vals")
    label_json = F.coalesce(F.to_json(F.array(F.col("label"))), F.lit("[null]"))
    head = F.substring(label_json, F.lit(1), F.length(label_json) - 1)

    def row_text(metrics: list[str]) -> Column:
        parts = [num(F.element_at(vals, x)) for x in metrics]
        return F.concat(head, F.lit(","), F.concat_ws(",", *parts), F.lit("]"))

    def scalar(mm: str) -> Column:
        return num(F.element_at(vals, mm))

    piece = (
        F.when(F.col("question") == "q3",
               F.concat(F.lit("["), F.concat_ws(",", scalar("avg_gpa"), scalar("avg_gre"),
                                                scalar("avg_gre_v"), scalar("avg_gre_aw")),
                        F.lit("]")))
        .when(F.col("question") == "q10", row_text(["total", "rejections", "rejection_pct"]))
        .when(F.col("question") == "q11", row_text(["total", "avg_gpa"]))
        .otherwise(F.element_at(F.map_values(F.transform_values(vals, lambda k, x: num(x))), 1))
    )
    per_q = rows.select("question", "row_no", piece.alias("piece")).groupBy("question").agg(
        F.sort_array(F.collect_list(F.struct("row_no", "piece"))).alias("ps"))
    body = F.when(F.col("question").isin("q10", "q11"),
                  F.concat(F.lit("["), F.array_join(F.col("ps.piece"), ","), F.lit("]"))) \
        .otherwise(F.element_at(F.col("ps.piece"), 1))
    entries = per_q.select(
        F.regexp_extract("question", r"(\d+)", 1).cast("int").alias("n"),
        F.substring(F.to_json(F.array("question")), F.lit(2), F.length(F.to_json(F.array("question")))).alias("k"), body.alias("body"))
    entries = entries.select("n", F.concat(
        F.regexp_replace("k", r"\]$", ""), F.lit(":"), F.col("body")).alias("kv"))
    return entries.agg(F.concat(
        F.lit("{"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "kv"))),
                                 lambda s: s["kv"]), ","),
        F.lit("}")).alias("report"))
