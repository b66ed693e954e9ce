"""Staged appends, commit markers, file statistics and the load's single pass."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from admitlens.operators import load as L
from admitlens.schema import APPLICANTS
from admitlens.sources import tables as S


def rows(spark, keys, status="Accepted"):
    return spark.createDataFrame([(k, f"U{k}", status, f"Fall {2020 + k % 3}") for k in keys],
                                 "applicantNumber long, university string, status string, semester string")


def ids(df):
    return sorted(r.p_id for r in df.select("p_id").collect())


@pytest.mark.parametrize("step, before", [("rows", False), ("rejects", False), ("commit", True), ("commit", False)])
def test_a_load_that_dies_leaves_nothing_and_comes_again_once(spark, tmp_path, monkeypatch, step, before):
    t = S.ApplicantsTable(spark, str(tmp_path / "t"))
    L.load_batch(t, rows(spark, [1, 2]))
    batch = rows(spark, [2, 3, 4]).withColumn("applicantNumber", F.col("applicantNumber").cast("string")).union(
        spark.createDataFrame([("bad", "U", "x", "Fall 2020")], "a string, b string, c string, d string"))
    whole = getattr(S.Staged, step)

    def dies(self, *args):
        if not before:
            whole(self, *args)
        raise RuntimeError("lost")

    monkeypatch.setattr(S.Staged, step, dies)
    with pytest.raises(RuntimeError):
        L.load_batch(t, batch)
    monkeypatch.undo()
    seen = step == "commit" and not before          # the marker is the last step
    assert ids(t.scan()) == ([1, 2, 3, 4] if seen else [1, 2])
    assert t.rejects().count() == (1 if seen else 0)
    for _ in range(2):
        stats = L.load_batch(t, batch).first()
        assert ids(t.scan()) == [1, 2, 3, 4] and t.rejects().count() == 1
    assert stats.asDict() == {"inserted": 0, "skipped": 3, "rejected": 1}


def test_rows_rejects_and_watermarks_become_visible_together(spark, tmp_path):
    t = S.ApplicantsTable(spark, str(tmp_path / "t"))
    w = S.WatermarkTable(spark, str(tmp_path / "w"), t.commits)
    staged, stats = L.stage_batch(t, rows(spark, [7, 8]), batch_id="odd id/with=signs %")
    staged.watermarks(w, spark.createDataFrame([("listing", "8")], "source string, last_seen string").withColumn(
        "updated_at", F.lit("2025-01-01").cast("timestamp_ntz")))
    assert stats.first().inserted == 2
    assert t.scan().count() == 0 and w.scan().count() == 0 and t.commits.ids() == []
    staged.commit()
    assert ids(t.scan()) == [7, 8] and w.scan().first().last_seen == "8"
    assert t.commits.ids() == ["odd id/with=signs %"]
    again, _ = L.stage_batch(t, rows(spark, [9]), batch_id="b2")
    again.roll_back()
    assert ids(t.scan()) == [7, 8] and not t.commits.exists(f"{t.path}/batch=b2")


def test_equal_rejects_of_two_batches_are_both_kept(spark, tmp_path):
    t = S.ApplicantsTable(spark, str(tmp_path / "t"))
    for k in ("1", "2"):
        L.load_batch(t, spark.createDataFrame([(k, "U"), ("bad", "V")], "applicantNumber string, university string"))
    assert ids(t.scan()) == [1, 2] and t.rejects().count() == 2


def test_only_files_that_may_hold_a_key_are_read(spark, tmp_path):
    t = S.ApplicantsTable(spark, str(tmp_path / "t"))
    names = [f.name for f in APPLICANTS.fields]
    for i in range(16):          # ranges overlap in pairs; even and odd keys lie in different files
        lo = 1000 * (i // 2)
        some = [tuple(k if n == "p_id" else f"Fall {2020 + k % 3}" if n == "semester" else None for n in names)
                for k in range(lo + i % 2, lo + 1000, 2)]
        t.append(spark.createDataFrame(some, APPLICANTS), f"b{i:02}")
    every = len(t.scan().inputFiles())
    keys = spark.createDataFrame([(3001,), (3003,), (7002,), (10**9,), (None,)], "p_id long")
    files = t.key_files(keys, 100)
    assert 3 <= len(files) <= 5 < every / 8
    known = t.scan_for_keys(keys, 100)
    assert sorted(known.join(keys, "p_id").toPandas()["p_id"]) == [3001, 3003, 7002]
    # Every key of the table is found; what the filter lets in by chance changes nothing.
    some = spark.range(0, 8500, 7).select(F.col("id").alias("p_id"))
    assert ids(L.insert_ignore(t.scan_for_keys(some, 100_000), some, "p_id")) == ids(L.insert_ignore(t.scan(), some, "p_id"))
    assert t.key_files(some, 10) is None and t.scan_for_keys(some, 10).count() == 8000
    assert t.key_files(spark.createDataFrame([(-5,)], "p_id long"), 10) == []


def test_full_filters_and_negative_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_WORDS", 1)      # every filter is full: no file is left out by it
    t = S.ApplicantsTable(spark, str(tmp_path / "t"))
    L.load_batch(t, rows(spark, range(-50, 50)))
    assert L.load_batch(t, rows(spark, range(-60, 60), "again")).first().inserted == 20
    assert t.scan().where("status = 'Accepted'").count() == 100


def test_a_load_reads_its_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    raw = rows(spark, range(500)).repartition(3)
    batch = raw.mapInPandas(note, raw.schema)
    t = S.ApplicantsTable(spark, str(tmp_path / "t"))
    assert L.load_batch(t, batch).first().inserted == 500
    assert seen.value == 500
