"""Numbering (gap case), stop rule, clamp, report formatting and JSON."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from admitlens.functions.numbers import clamp_limit
from admitlens.operators import incremental as I
from admitlens.operators import questions as Q
from admitlens.operators import report as R
from admitlens.plans.applicants_view import applicants_view


def test_next_key_survives_gaps(spark):
    table = spark.createDataFrame([(1,), (2,), (5,)], "p_id int")
    assert I.next_key(table) == 6  # count+1 would collide with 4..5 region
    assert I.next_key(spark.createDataFrame([], "p_id int")) == 1


def test_number_rows_is_consecutive_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k")).repartition(7)
    out = I.number_rows(df, ["k"], 10).collect()
    assert sorted((r.k, r.p_id) for r in out) == [(k, 10 + k) for k in range(5000)]


def test_stop_at_first_fully_seen_page(spark):
    rows = [(1, "a", False), (1, "b", True), (2, "c", True), (3, "d", False)]
    df = spark.createDataFrame(rows, "page_id int, url string, is_known boolean")
    kept = I.stop_at_seen_page(df, I.page_novelty(df))
    assert sorted(r.url for r in kept.collect()) == ["a", "b"]


def test_known_flag_is_null_safe(spark):
    batch = spark.createDataFrame([("a",), (None,), ("b",)], "url string")
    table = spark.createDataFrame([(None,), ("a",)], "url string")
    got = sorted((r.url or "", r.is_known) for r in I.known_flag(batch, table).collect())
    assert got == [("", True), ("a", True), ("b", False)]


@pytest.mark.parametrize("given,expected", [(-5, 1), (0, 1), (1, 1), (100, 100), (101, 100),
                                            ("7", 7)])
def test_clamp_limit(given, expected):
    assert clamp_limit(given) == expected


def test_report_text_and_json(spark, sf_small):
    answers = Q.run_all(applicants_view(spark, sf_small))
    fmt = {(r.question, r.metric, r.row_no): r.text
           for r in R.format_report(answers).collect()}
    assert fmt[("q1", "total", 1)] == "90"
    assert fmt[("q2", "international_pct", 1)] == "34.67%"
    assert fmt[("q10", "total", 1)] == "15"
    doc = json.loads(R.report_json(answers).first().report)
    assert doc["q1"] == 90 and doc["q2"] == 34.67
    assert doc["q3"] == [3.0, 149.87, 150.0, 2.99]
    assert doc["q10"][0] == ["Spring 2026", 15, 3, 20.0]
    assert doc["q11"] == [["Accepted", 13, 3.18], ["Rejected", 12, 2.99]]
    assert list(doc) == [f"q{i}" for i in range(1, 12)]
