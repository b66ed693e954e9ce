"""Load (L1–L8) idempotency / overlap / rejects, and the eleven questions on
the fixture records with the answers derived in FIXTURES.md §3."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from admitlens.operators import load as L
from admitlens.operators import questions as Q
from admitlens.schema import RECORD_MAP
from admitlens.sources.tables import ApplicantsTable

SAMPLE = [
    {"applicantNumber": 7101, "university": "Johns Hopkins", "program": "Computer Science", "degreeType": "Masters",
     "datePosted": "Mar 3, 2026", "status": "Accepted", "semester": "Fall 2026", "citizenship": "American",
     "gpa": 3.4, "gre": 150, "gre_v": 151, "gre_aw": 3.0, "url": "p/7101"},
    {"applicantNumber": 7102, "university": "Hillside College", "program": "Physics", "degreeType": "PhD",
     "datePosted": "Mar 4, 2026", "status": "Rejected", "semester": "Fall 2026", "citizenship": "International",
     "gpa": 3.1, "gre": 140, "gre_v": 161, "gre_aw": 5.0, "url": "p/7102"},
]
# 3.85 and 4.0 average to a tie in the third place (3.925 -> 3.93).
MULTI = [
    {"applicant_number": 8201, "university": "Carnegie Mellon University", "program": "Computer Science",
     "degree_type": "PhD", "status": "Accepted", "semester": "Fall 2026", "citizenship": "International",
     "gpa": 3.85, "gre": 150.0, "gre_v": 140.0, "gre_aw": 3.0, "llm_generated_program": "Computer Science",
     "llm_generated_university": "Carnegie Mellon University"},
    {"applicant_number": 8202, "university": "MIT", "program": "Computer Science", "degree_type": "PhD",
     "status": "Accepted", "semester": "Fall 2026", "citizenship": "American", "gpa": 4.0, "gre": 155.0,
     "gre_v": 150.0, "gre_aw": 4.0, "llm_generated_program": "Computer Science",
     "llm_generated_university": "Massachusetts Institute of Technology"},
    {"applicant_number": 8203, "university": "Stanford University", "program": "Computer Science",
     "degree_type": "PhD", "status": "Rejected", "semester": "Fall 2026", "citizenship": "American", "gpa": 3.2,
     "gre": 160.0, "gre_v": 151.0, "gre_aw": 5.5, "llm_generated_program": "Computer Science",
     "llm_generated_university": "Stanford University"},
]


def _batch(spark, records):
    import json

    df = spark.createDataFrame([(json.dumps(r),) for r in records], "body string")
    return df.select(F.from_json("body", RECORD_MAP).alias("rec"))


def _table(spark, tmp_path):
    return ApplicantsTable(spark, str(tmp_path / f"t-{uuid.uuid4().hex}"))


def test_load_twice_is_idempotent(spark, tmp_path):
    t = _table(spark, tmp_path)
    s1 = L.load_batch(t, _batch(spark, SAMPLE), map_col="rec").first()
    s2 = L.load_batch(t, _batch(spark, SAMPLE), map_col="rec").first()
    assert (s1.inserted, s1.skipped, s1.rejected) == (2, 0, 0)
    assert (s2.inserted, s2.skipped, s2.rejected) == (0, 2, 0)
    assert t.scan().count() == 2


def test_overlap_and_first_wins(spark, tmp_path):
    t = _table(spark, tmp_path)
    L.load_batch(t, _batch(spark, MULTI[:2]), map_col="rec")
    changed = dict(MULTI[1], status="Wait listed")
    L.load_batch(t, _batch(spark, [changed] + MULTI[1:]), map_col="rec")
    rows = {r.p_id: r.status for r in t.scan().collect()}
    assert rows == {8201: "Accepted", 8202: "Accepted", 8203: "Rejected"}


def test_bad_row_is_rejected_not_fatal(spark, tmp_path):
    t = _table(spark, tmp_path)
    bad = dict(SAMPLE[0], applicantNumber=None)
    s = L.load_batch(t, _batch(spark, [bad] + SAMPLE), map_col="rec").first()
    assert (s.inserted, s.rejected) == (2, 1)
    assert t.scan().count() == 2
    L.load_batch(t, _batch(spark, [bad] + SAMPLE), map_col="rec")      # a replay keeps its rejects once
    assert [r.reject_reason for r in t.rejects().collect()] == ["missing_key"]


def test_keys_beyond_32_bits_and_integral_text(spark, tmp_path):
    t = _table(spark, tmp_path)
    keys = [2147483648, "9000000000001.0", " 42 ", "1.5", "x", "99999999999999999999"]
    s = L.load_batch(t, _batch(spark, [dict(SAMPLE[0], applicantNumber=k) for k in keys]), map_col="rec").first()
    assert (s.inserted, s.rejected) == (3, 3)
    assert {r.p_id for r in t.scan().collect()} == {2147483648, 9000000000001, 42}


def test_first_of_several_files_wins_by_stated_order(spark, tmp_path):
    import json

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps(dict(SAMPLE[0], status="FIRST")) + "\n")
    more = [dict(SAMPLE[0], status="SECOND")] + [dict(SAMPLE[1], applicantNumber=9000 + i) for i in range(500)]
    (src / "b.json").write_text("\n".join(json.dumps(r) for r in more) + "\n")
    raw = spark.read.text(str(src))
    parsed = raw.select(F.from_json("value", RECORD_MAP).alias("rec"))
    t = _table(spark, tmp_path)
    with pytest.raises(ValueError):
        L.load_batch(t, parsed, map_col="rec")
    order = raw.select(F.from_json("value", RECORD_MAP).alias("rec"),
                       *[c.alias(f"o{i}") for i, c in enumerate(L.file_order())])
    for _ in range(2):
        L.load_batch(t, order, map_col="rec", order_cols=["o0", "o1", "o2"])
    assert {r.status for r in t.scan().filter("p_id = 7101").collect()} == {"FIRST"}
    assert t.scan().count() == 501


def test_numbers_as_python_reads_them(spark):
    from admitlens.functions.numbers import try_double

    texts = ["3.88", " 4 ", "3.88f", "3.5D", "0x1p3", "1e2", ".5", "5.", "inf", "nan", "", "1_000", "-2"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(try_double(F.col("x"))).collect()]
    assert got == [3.88, 4.0, None, None, None, 100.0, 0.5, 5.0, float("inf"), None, None, got[11], -2.0]


def test_links_join_like_the_standard_library(spark):
    from urllib.parse import urljoin

    from admitlens.functions.records import resolve_url

    base = "https://h.test/a/b?x=1"
    links = ["/r/1", "/r/1#", "/r/1?", "https://b.test/k#", "https://b.test/k", "k", "../k", "?q=1", "#f", "", "/a\tb", "/a b",
             "//c.test/x", "http://d.test", "/é", "mailto:x@y", "//[bad", "/%7Ea?b=c", "https://[bad/x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in links], "x string").select(
        resolve_url(F.lit(base), F.col("x"))).collect()]

    def want(x):
        try:
            return urljoin(base, x)
        except ValueError:
            return None

    assert got == [want(x) for x in links]


def test_title_case_of_every_cased_code_point(spark):
    from admitlens.functions.text import title_case

    odd = {chr(c) for c in range(0x80, 0x2C00) if chr(c).upper() != chr(c) and chr(c).title() != chr(c).upper()}
    texts = [f"1{chr(c)}ano {chr(c)}x" for c in range(0x80, 0x2C00) if chr(c) not in odd and chr(c).isprintable()
             and (chr(c).islower() or chr(c).isupper()) and len(chr(c).lower()) == 1 and len(chr(c).upper()) == 1]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", title_case(F.col("t")).alias("x"))
    wrong = [(r.t, r.x, r.t.title()) for r in df.collect() if r.x != r.t.title() and r.t[1] not in "ͅ"]
    assert len(wrong) <= len(texts) // 100, wrong[:20]


def test_duplicate_inside_batch_first_wins(spark, tmp_path):
    t = _table(spark, tmp_path)
    dup = dict(SAMPLE[0], status="Rejected")
    L.load_batch(t, _batch(spark, [SAMPLE[0], dup]), map_col="rec")
    assert [r.status for r in t.scan().collect()] == ["Accepted"]


def _answers(spark, tmp_path, records):
    t = _table(spark, tmp_path)
    L.load_batch(t, _batch(spark, records), map_col="rec")
    df = t.scan()
    one = {k: list(fn(df).first()) for k, fn in Q.QUESTIONS.items() if k not in ("q10", "q11")}
    one["q10"] = [tuple(r) for r in Q.rejection_rate_by_term(df).collect()]
    one["q11"] = [tuple(r) for r in Q.gpa_by_outcome(df).collect()]
    return one


@pytest.mark.parametrize("which", ["sample", "multi"])
def test_questions_fixture_answers(spark, tmp_path, which):
    a = _answers(spark, tmp_path, SAMPLE if which == "sample" else MULTI)
    if which == "sample":
        assert a["q1"] == [2] and a["q2"] == [50.0] and a["q3"] == [3.25, 145.0, 156.0, 4.0]
        assert a["q4"] == [3.4] and a["q5"] == [50.0] and a["q6"] == [3.4]
        assert a["q7"] == [1] and a["q8"] == [0] and a["q9"] == [0]
        assert a["q10"] == [("Fall 2026", 1, 1, 100.0)]
        assert a["q11"] == [("Rejected", 1, 3.1)]
    else:
        assert a["q1"] == [3] and a["q2"] == [33.33] and a["q3"] == [3.68, 155.0, 147.0, 4.17]
        assert a["q4"] == [3.6] and a["q5"] == [66.67] and a["q6"] == [3.93]
        assert a["q7"] == [0] and a["q8"] == [2] and a["q9"] == [2]
        assert a["q10"] == [("Fall 2026", 3, 1, 33.33)]
        assert a["q11"] == [("Accepted", 2, 3.93), ("Rejected", 1, 3.2)]


def test_empty_table_gives_null_not_error(spark, tmp_path):
    t = _table(spark, tmp_path)
    df = t.scan()
    assert Q.citizenship_pct(df).first()[0] is None
    assert Q.term_count(df).first()[0] == 0
    assert Q.scalar_bundle(df).first()["q5_acceptance_pct"] is None


def test_replaceable_question_set(spark, tmp_path):
    t = _table(spark, tmp_path)
    L.load_batch(t, _batch(spark, SAMPLE), map_col="rec")
    custom = {"n": lambda df: df.groupBy().count(), "q1": Q.term_count}
    got = {k: v.first()[0] for k, v in Q.answer_set(t.scan(), custom).items()}
    assert got == {"n": 2, "q1": 2}


def test_missing_dictionary_is_empty_and_table_drop(spark, tmp_path):
    from admitlens.sources.records import read_dictionary

    assert read_dictionary(spark, str(tmp_path / "absent.txt")).count() == 0
    p = tmp_path / "dict.txt"
    p.write_text("  McGill University \n\n\tStanford University\n   \n")
    got = [(r.name, r.pos) for r in read_dictionary(spark, str(p)).orderBy("pos").collect()]
    assert [g[0] for g in got] == ["McGill University", "Stanford University"]
    t = _table(spark, tmp_path)
    t.ensure()
    assert t.exists()
    t.drop()
    assert not t.exists()


def test_prompt_messages_and_watermark_keeps_absent_source(spark):
    import json

    from admitlens.fixed_values import FEW_SHOTS, SYSTEM_PROMPT
    from admitlens.operators.incremental import advance_watermark
    from admitlens.operators.normalize import build_prompts

    df = spark.createDataFrame([("Café U", 'Math "pure"')], "u string, p string")
    msgs = build_prompts(df, "u", "p").first().messages
    assert msgs[0].content == SYSTEM_PROMPT and len(msgs) == 2 + 2 * len(FEW_SHOTS)
    assert msgs[1].content == json.dumps(FEW_SHOTS[0][0], ensure_ascii=False)
    assert msgs[-1].content == json.dumps({"university": "Café U", "program": 'Math "pure"'},
                                          ensure_ascii=False)
    old = spark.createDataFrame([("a", "1", "2024-01-01 00:00:00"), ("b", "7", "2024-01-01 00:00:00")],
                                "source string, last_seen string, updated_at string") \
        .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    batch = spark.createDataFrame([("a", 2, "2024-02-01 00:00:00")], "s string, v int, ts string")
    got = {r.source: r.last_seen for r in advance_watermark(old, batch, "s", "v", "ts").collect()}
    assert got == {"a": "2", "b": "7"}


def test_strict_report_keeps_what_was_answered(spark, tmp_path):
    t = _table(spark, tmp_path)
    L.load_batch(t, _batch(spark, SAMPLE), map_col="rec")

    def broken(df):
        raise ValueError("question three")

    done, why = Q.answer_until_failure(t.scan(), {"q1": Q.term_count, "q2": Q.citizenship_pct, "q3": broken, "q4": Q.term_count})
    assert done == {"q1": [(2,)], "q2": [(50.0,)]} and why == "q3: ValueError: question three"
    assert Q.answer_until_failure(t.scan())[1] is None


def test_many_rules_and_uncapped_limits(spark):
    from admitlens.functions.numbers import clamp_limit
    from admitlens.operators.normalize import expand_abbreviation

    rules = [(f"r{i}", f"R{i}") for i in range(1500)]
    df = spark.createDataFrame([("r0",), ("r1499",), ("x",)], "t string")
    assert [r[0] for r in df.select(expand_abbreviation(F.col("t"), rules)).collect()] == ["R0", "R1499", "x"]
    assert clamp_limit(500) == 100 and clamp_limit(500, None) == 500


def test_pages_are_numbered_without_a_global_sort(spark):
    from admitlens.operators.incremental import number_by_page

    rows = [(p, i) for p in (3, 1, 7, None, 20) for i in range(p or 2)]
    df = spark.createDataFrame(rows, "page_id long, record_no long").repartition(5)
    got = sorted((r.p_id, r.page_id, r.record_no) for r in number_by_page(df, "page_id", "record_no", 100).collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(100 + i, *r) for i, r in enumerate(want)]


def test_fuzzy_scores_few_of_all_pairs(spark):
    from admitlens.operators.fuzzy import candidate_pairs

    d = spark.range(2000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("d"))
    q = d.selectExpr("concat(d, 's') AS q")
    assert 2000 <= candidate_pairs(q, d, 0.84).count() < 0.05 * 2000 * 2000
