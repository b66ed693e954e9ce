"""The message log and its source, runs of messages, faults of the ingest, page waves."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from admitlens.operators import extract as E
from admitlens.operators import incremental as I
from admitlens.operators import load as L
from admitlens.sources import tables as S
from admitlens.streaming import handlers as H
from admitlens.streaming import messages as M
from admitlens.streaming import tasks as T


def log_of(spark, path, kinds, start=0):
    rows = [(start + i, k if k.startswith("{") or k == "bad{" else json.dumps({"kind": k, "ts": f"t{start + i}"})) for i, k in enumerate(kinds)]
    M.append_messages(spark.createDataFrame(rows, "n long, value string").repartition(3), path, ["n"])
    return path


def consumed(spark, tmp_path, kinds, handlers, pace=100, name="x"):
    dead = str(tmp_path / f"dead-{name}")
    log: list = []
    path = log_of(spark, str(tmp_path / f"log-{name}"), kinds)
    T.consume_log(spark, path, handlers, dead, str(tmp_path / f"ck-{name}"), pace, log)
    return sorted((json.loads(r.value)["ts"] if "ts" in r.value else r.value, r.reason) for r in spark.read.parquet(dead).collect()), log


def test_runs_are_handled_in_order_and_halved_to_the_failing_message(spark, tmp_path):
    ran = []

    def handler(kind):
        def handle(df, _):
            got = sorted(int(r.ts[1:]) for r in df.collect())
            if kind == "scrape" and 7 in got:
                raise RuntimeError("7")
            ran.append((kind, got))
        return handle

    handlers = {k: handler(k) for k in ("scrape", "recompute")}
    dead, log = consumed(spark, tmp_path, ["scrape", "recompute", "scrape"], handlers)
    assert [k for k, _ in ran] == ["scrape", "recompute", "scrape"] and dead == [] and log == []
    ran.clear()
    kinds = ["scrape"] * 4 + ["bad{"] + ["scrape"] * 5 + ["other", "recompute", "recompute"]
    dead, log = consumed(spark, tmp_path, kinds, handlers, name="y")
    assert dead == [("bad{", "malformed"), ("t10", "unknown_kind"), ("t7", "handler_failed")]
    handled = [n for k, got in ran for n in got]
    assert handled == [0, 1, 2, 3, 5, 6, 8, 9, 11, 12] and ran[-1] == ("recompute", [11, 12])
    assert len(log) == 1


def test_the_source_paces_by_messages_and_goes_on_after_a_restart(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []

    def note(df, batch_id):
        seen.append((batch_id, [r.number for r in df.orderBy("number").collect()]))

    def drain(pace):
        q = (M.read_message_stream(spark, path, pace).writeStream.foreachBatch(note)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start())
        q.processAllAvailable()
        q.stop()

    assert M.log_length(path) == 0
    log_of(spark, path, ["a"] * 7)
    drain(3)
    assert seen == [(0, [0, 1, 2]), (1, [3, 4, 5]), (2, [6])]
    drain(3)
    assert len(seen) == 3                                   # nothing new
    log_of(spark, path, ["a"] * 4, 7)
    assert M.log_length(path) == 11
    drain(3)
    assert seen[3:] == [(3, [7, 8, 9]), (4, [10])]


def test_a_gap_in_the_log_hides_what_follows(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, path, ["a"] * 5)
    spark.createDataFrame([(9, "x", 9)], "number long, value string, first long").write.mode("append").partitionBy("first").parquet(path)
    assert M.log_length(path) == 5


ROW = ("<tr><td><div class='tw-font-medium tw-text-gray-900 tw-text-sm'>U{0}</div></td><td><span>P</span><span>D</span></td>"
       "<td>Jan 1, 2025</td><td>Accepted on 2 Feb</td><td><a href='/r/{0}'>go</a></td></tr><tr><td></td></tr>")


def listing(spark, pages, per_page=3):
    rows = [(p, "<table>" + "".join(ROW.format(per_page * p + i) for i in range(per_page)) + "</table>") for p in pages]
    return spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("x"))


@pytest.mark.parametrize("seen_page", [0, 21, None])
def test_waves_parse_at_most_twice_the_pages_needed(spark, seen_page):
    parsed = spark.sparkContext.accumulator(0)
    pages = listing(spark, range(80))

    def parse(some):
        def note(batches):
            for b in batches:
                parsed.add(len(b))
                yield b
        return E.extract_listing(some.mapInPandas(note, some.schema), "https://example.test/")

    urls = [] if seen_page is None else [(f"https://example.test/r/{3 * seen_page + i}", 100 + i) for i in range(3)]
    table = spark.createDataFrame(urls, "url string, p_id long")
    waves: list = []
    got = I.incremental_pull(pages, parse, table, first_wave=2, waves=waves).orderBy("p_id").collect()
    kept = 80 if seen_page is None else seen_page
    assert [r.url for r in got] == [f"https://example.test/r/{i}" for i in range(3 * kept)]
    first = 1 if seen_page is None else 103
    assert [r.p_id for r in got] == list(range(first, first + 3 * kept))
    needed = kept + (seen_page is not None)
    assert needed <= parsed.value <= max(2, 2 * needed)
    assert (waves[-1][2] == seen_page) and all(w[2] is None for w in waves[:-1])
    whole = I.incremental_update(E.extract_listing(pages), table)
    assert sorted(tuple(r) for r in whole.select("p_id", "url").collect()) == [(r.p_id, r.url) for r in got]


STEPS = [(S.Staged, "rows"), (S.Staged, "commit"), (L, "stage_batch")]


@pytest.mark.parametrize("owner, step", STEPS, ids=[s for _, s in STEPS])
def test_an_ingest_that_dies_is_unseen_and_its_replay_adds_each_row_once(spark, tmp_path, monkeypatch, owner, step):
    table = S.ApplicantsTable(spark, str(tmp_path / "t"))
    marks = S.WatermarkTable(spark, str(tmp_path / "w"), table.commits)
    stats: list = []
    handler = H.ingest_handler(table, lambda: listing(spark, range(4)), stats=stats, watermarks=marks)
    messages = spark.createDataFrame([('{"kind": "scrape_new_data", "ts": "1"}',)], "value string")
    whole = getattr(owner, step)

    def dies(*args, **kwargs):
        if step != "commit":
            whole(*args, **kwargs)                          # the step is done, the next is not reached
        raise RuntimeError("lost")

    monkeypatch.setattr(owner, step, dies)
    with pytest.raises(RuntimeError):
        handler(messages, 0)
    monkeypatch.undo()
    assert table.scan().count() == 0 and marks.scan().count() == 0 and stats == []
    for _ in range(2):
        handler(messages, 0)
    assert sorted(r.p_id for r in table.scan().collect()) == list(range(1, 13))
    assert [r.last_seen for r in marks.scan().collect()] == ["12"]
    assert [x["inserted"] for _, x in stats] == [12]        # the second replay was committed already


def test_runs_of_messages_that_lie_across_tasks(spark):
    rows = [(i, "ab"[(i // 7) % 2] if i % 5 else "malformed") for i in range(200)]
    df = spark.createDataFrame(rows, f"{T.PLACE} long, route string")
    expected: list = []
    for place, kind in rows:
        if kind == "malformed":
            continue
        if expected and expected[-1][0] == kind:
            expected[-1] = (kind, expected[-1][1], place, expected[-1][3] + 1)
        else:
            expected.append((kind, place, place, 1))
    for some in (df.coalesce(1), df.repartition(6), df.repartitionByRange(4, T.PLACE), df.orderBy(F.desc(T.PLACE))):
        assert T.message_runs(some, ["a", "b"]) == expected
    assert T.message_runs(df.where("false"), ["a", "b"]) == []


def test_a_folder_of_the_log_is_opened_once(spark, tmp_path, monkeypatch):
    import pyarrow.dataset as ds

    path, opened, whole = str(tmp_path / "log"), [], ds.dataset
    monkeypatch.setattr(M, "BLOCK", 10)
    log_of(spark, path, ["a"] * 95)
    monkeypatch.setattr(ds, "dataset", lambda folder, **kw: opened.append(folder) or whole(folder, **kw))
    reader, at, found = M._Reader(path, 7), 0, []
    while (end := reader.latestOffset()["number"]) > at:
        parts = reader.partitions({"number": at}, {"number": end})
        assert sum(len(p.folders) for p in parts) <= 2
        before = len(opened)
        found += [n for p in parts for n, _ in reader.read(p)]
        del opened[before:]                                 # what reading opens
        at = end
    assert found == list(range(95)) and len(opened) == len(set(opened)) == 10
    again = M._Reader(path, 7)                              # a restart plans its last batch first
    parts = again.partitions({"number": 14}, {"number": 21})
    assert [n for p in parts for n, _ in again.read(p)] == list(range(14, 21))


def test_filters_hold_every_key_and_are_made_of_words(spark, tmp_path):
    path = str(tmp_path / "keys")
    spark.range(0, 3000, 1, 2).selectExpr("id * 7 - 50 as p_id").write.parquet(path)
    stats = S.file_statistics(spark.read.parquet(path))
    assert "Generate" not in stats._jdf.queryExecution().sparkPlan().toString()
    for r in stats.collect():
        keys = spark.read.parquet(r.file).select(*[h.alias(f"h{i}") for i, h in enumerate(S._places(F.col("p_id")))]).collect()
        places = {h % (len(r["words"]) * 64) for k in keys for h in k}
        held = {64 * i + b for i, w in enumerate(r["words"]) for b in range(64) if w >> b & 1}
        assert held == places



@pytest.mark.parametrize("limits", [(20_000, 2_000), (0, 2_000), (20_000, 5)], ids=["held", "many", "long"])
def test_a_batch_held_by_the_driver_is_handled_like_one_the_cluster_keeps(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(T, "HELD_MESSAGES", limits[0])
    monkeypatch.setattr(T, "HELD_LENGTH", limits[1])
    kept, whole, ran = [], T._Stored.__init__, []
    monkeypatch.setattr(T._Stored, "__init__", lambda self, *a: kept.append(1) or whole(self, *a))

    def handler(kind):
        def handle(df, batch_id):
            assert df.columns == [*T.DECODED_COLUMNS, "route"]
            got = sorted((r.ts, r.payload, r.status, r.route) for r in df.collect())
            if ("t9", "{}", "ok", "b") in got:
                raise RuntimeError("t9")
            ran.append((batch_id, kind, got))
        return handle

    kinds = ["a", "a", "bad{", "a", "other", "b", "a", "b", "b", "b", "b", '{"kind": "a", "ts": "t11", "payload": {"x": [1]}}', "bad{", '{"kind": "b", "ts": "t13"} ']
    progress = str(tmp_path / "p")
    path, dead = log_of(spark, str(tmp_path / "log"), kinds), str(tmp_path / "dead")
    T.consume_log(spark, path, {k: handler(k) for k in "ab"}, dead, str(tmp_path / "ck"), 12, None, progress)
    assert bool(kept) == (limits != (20_000, 2_000))
    one = [(f"t{i}", "{}", "ok", k) for i, k in enumerate(kinds)]
    assert ran == [(0, "a", [one[0], one[1], one[3]]), (0, "b", [one[5]]), (0, "a", [one[6]]), (0, "b", [one[7], one[8]]), (0, "b", [("t10", "{}", "ok", "b")]),
                   (0, "a", [("t11", '{"x":[1]}', "ok", "a")]), (1, "b", [("t13", "{}", "ok", "b")])]
    letters = spark.read.parquet(dead)
    assert dict(letters.dtypes) == {"value": "string", "reason": "string", "batch_id": "int"}
    assert sorted((r.value, r.reason, r.batch_id) for r in letters.collect()) == [
        ("bad{", "malformed", 0), ("bad{", "malformed", 1), ('{"kind": "b", "ts": "t9"}', "handler_failed", 0), ('{"kind": "other", "ts": "t4"}', "unknown_kind", 0)]
    assert sorted(map(tuple, T.read_progress(spark, progress).collect())) == [(0, 12), (1, 2)]


def test_a_batch_of_files_is_held_in_order_and_letters_are_replaced(spark, tmp_path):
    seen: list = []
    process = T.make_batch_processor({"a": lambda df, _: seen.append([r.ts for r in df.collect()])}, str(tmp_path / "dead"), progress_path=str(tmp_path / "p"))
    lines = [json.dumps({"kind": "a", "ts": str(i)}) if i % 10 else "{" for i in range(100)]
    for some in (lines, lines[:25]):                        # a replay with fewer messages
        process(spark.createDataFrame([(x,) for x in some], "value string").repartition(1).repartition(3), 7)
    assert [sorted(map(int, s)) for s in seen] == [[i for i in range(100) if i % 10], [i for i in range(25) if i % 10]]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 3
    assert T.read_progress(spark, str(tmp_path / "p")).collect() == [(7, 25)]
    process(spark.createDataFrame([], "value string"), 8)   # nothing: folders with a schema
    assert spark.read.parquet(str(tmp_path / "dead/batch_id=8")).columns == ["value", "reason", "batch_id"]


def test_a_message_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "value string")
    assert T.decode_tasks(df)._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_a_batch_is_read_by_a_few_tasks(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, path, ["a"] * 5000)
    for pace, parts in ((100, 1), (1500, 2), (5000, 4)):
        planned = M._Reader(path, pace).partitions({"number": 0}, {"number": pace})
        assert len(planned) == parts and planned[0].start == 0 and planned[-1].end == pace
        assert all(a.end == b.start for a, b in zip(planned, planned[1:]))


def test_runs_of_a_held_batch_are_no_jobs(spark, tmp_path):
    got: list = []

    def handle(df, _):
        if not df.where(F.col("ts") == "7").isEmpty():
            raise RuntimeError("7")
        got.append([r.ts for r in df.collect()])

    process = T.make_batch_processor({"a": handle, "b": handle}, str(tmp_path / "dead"), most=100)
    rows = [(i, json.dumps({"kind": "ab"[i // 3 % 2], "ts": str(i)})) for i in range(60)]
    batch = spark.createDataFrame(rows, "number long, value string")
    spark.sparkContext.setJobGroup("runs-of-a-held-batch", "")
    try:
        process(batch, 0)
    finally:
        spark.sparkContext.setJobGroup("other", "")
    assert sorted(int(x) for some in got for x in some) == [i for i in range(60) if i != 7] and max(map(len, got)) == 3
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("runs-of-a-held-batch")) <= 2
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["handler_failed"]
