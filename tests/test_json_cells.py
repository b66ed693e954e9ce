"""JSON as Python reads it, and mergeable answers."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.functions.text import json_from_chatter, json_object
from admitlens.operators import questions as Q
from admitlens.plans.applicants_view import applicants_view
from admitlens.sources.records import read_envelope
from admitlens.sources.tables import ApplicantsTable
from admitlens.streaming import tasks


def test_objects_are_read_as_python_reads_them(spark):
    texts = ['{"kind":"a","kind":"b"}', '{"kind":"a","payload":{"v":NaN}}', '{"kind":"a"} x', '{"kind":"a"} {"kind":"b"}', '{"kind":"a"}{',
             "[1]", '"t"', "5", "", "  ", "null", "{}", ' {"kind": "5", "ts": null} ', '{"kind":"}{\\"","ts":"x"}', '{"kind":"a",}',
             "{kind:1}", "{'kind':'1'}", '{"a":[1,2,{"b":Infinity}],"kind":"q"}', "not json{{{", None, '{"kind":"\\\\"}', '{"kind":"a"}\n', "{"]
    rnd = random.Random(3)
    parts = ['{', '}', '"kind"', ':', '"a"', ',', '"ts"', '[', ']', ' ', '1', 'NaN', '"}"', '\\"']
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    texts += ['{"kind":' + "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) + "}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.j for r in df.select("i", json_object(F.col("t"), "kind string, ts string").alias("j")).collect()}
    objects = 0
    for i, t in enumerate(texts):
        try:
            v = json.loads(t)
        except (ValueError, TypeError):
            v = None
        ok = isinstance(v, dict)
        objects += ok
        assert (got[i]._corrupt is None) == ok, t
        if ok and isinstance(v.get("kind"), str):
            assert got[i].kind == v["kind"], t
        if not ok:
            assert got[i]._corrupt == (t or "")
    assert objects > 20


def test_envelopes_lose_no_rows_to_equal_keys_or_nan(spark):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    texts = ['[{"a":1,"a":2,"b":"x"},{"a":NaN}]', '{"rows":[{"a":1.5}]}', '{"rows":"no"}', '{"x":1}', '[{"a":1},', '[{"a":"bad","b":"kept"},{"a":3}]',
             "[]", '{"rows":[{"a":1}],"rows":[{"a":7}]}', "[1,2]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "g int, body string")
    got = [(r.g, "nan" if r.a is not None and math.isnan(r.a) else r.a, r.b) for r in read_envelope(df, "body", schema).collect()]
    assert len(got) == 6
    assert set(got) == {(0, 2.0, "x"), (0, "nan", None), (1, 1.5, None), (5, None, "kept"), (5, 3.0, None), (7, 7.0, None)}
    unread = {r.g: r.why for r in read_envelope(df, "body", schema, "why").collect() if r.why}
    assert unread == {2: "malformed", 3: "no_rows", 4: "malformed", 8: "malformed", 9: "malformed"}


def test_chatter_and_tasks_with_equal_keys(spark):
    df = spark.createDataFrame([('Sure: {"standardized_program": "A", "standardized_program": " B ", "x": NaN} ok',)], "t string")
    r = df.select(json_from_chatter(F.col("t")).alias("j")).first().j
    assert (r.ok, r.program, r.university) == (True, "B", "")
    m = spark.createDataFrame([('{"kind":"a","kind":"b","payload":{"x":NaN}}',), ('{"kind":"a"} tail',)], "value string")
    got = [(r.status, r.kind) for r in tasks.decode_tasks(m).collect()]
    assert got == [("ok", "b"), ("malformed", None)]


def as_rows(df):
    return sorted((r.question, r.row_no, r.label or "", r.metric, r.value if r.value is None else round(r.value, 9)) for r in df.collect())


def test_cells_of_parts_add_up_and_only_new_batches_are_scanned(spark, sf_small, tmp_path):
    av = applicants_view(spark, sf_small)
    whole = as_rows(Q.run_all(av))
    parts = [Q.answer_cells(av.where(F.col("p_id") % 3 == i)) for i in range(3)]
    assert as_rows(Q.answers_of(parts[0].unionByName(parts[1]).unionByName(parts[2]))) == whole
    one_by_one = {(q, m): v for q, _, _, m, v in whole}
    assert one_by_one["q3", "avg_gre"] == Q.average_scores(av).first().avg_gre
    t = ApplicantsTable(spark, str(tmp_path / "t"))
    assert as_rows(Q.refreshed_answers(t)) == as_rows(Q.run_all(t.scan()))          # no batch: empty answers
    scanned: list[list[str]] = []
    read = t.scan_batches
    t.scan_batches = lambda ids: scanned.append(ids) or read(ids)
    t.append(av.where("p_id % 3 = 0"), "b0")
    t.append(av.where("p_id % 3 = 1"), "b1")
    Q.refreshed_answers(t)
    t.append(av.where("p_id % 3 = 2"), "b2")
    t.stage("half done").rows(av)                                                    # not committed: not counted
    assert as_rows(Q.refreshed_answers(t)) == whole
    assert as_rows(Q.refreshed_answers(t)) == whole
    assert scanned == [["b0", "b1"], ["b2"]]
