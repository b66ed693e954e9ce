"""One JSON array read by many tasks equals the whole-file read."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from admitlens.sources.json_array import read_json_array

SCHEMA = "a long, b string, c struct<x:long,y:array<struct<z:string>>>"


def nasty(rnd):
    return "".join(rnd.choice(['{', '}', '"', '\\', ',', '[', ']', 'é', '漢', 'a', ' ', '\n', '},{"a":1}']) for _ in range(rnd.randint(0, 12)))


@pytest.mark.parametrize("indent, seed", [(None, 1), (2, 2), (None, 3)])
def test_splits_of_any_size_give_the_same_records(spark, tmp_path, indent, seed):
    rnd = random.Random(seed)
    rows = [{"a": i, "b": nasty(rnd), "c": {"x": i, "y": [{"z": nasty(rnd)} for _ in range(i % 3)]}} for i in range(300)]
    rows[7]["b"] = "}" * 900 + '"' * 30
    text = json.dumps(rows, indent=indent, ensure_ascii=seed == 3)
    (tmp_path / "x.json").write_text(text)
    whole = {(r.a, r.b, str(r.c)) for r in spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path / "x.json")).collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in (301, 4000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = read_json_array(spark, str(tmp_path / "x.json"), spark.read.schema(SCHEMA).json(spark.sparkContext.emptyRDD()).schema).collect()
            assert len(got) == 300 and {(r.a, r.b, str(r.c)) for r in got} == whole
            assert {(r.a, r.b) for r in got} == {(r["a"], r["b"]) for r in rows}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_several_files_and_empty_arrays(spark, tmp_path):
    for i, text in enumerate(["[]", "", " [ ] ", '[{"a": 1}]', '[\n{"a": 2},\n{"a": 3}\n]\n', "[5, {\"a\": 4}]", '["s{}}", {"a": 5}, "}{", null, {"a": 6}, "\\"}"]']):
        (tmp_path / f"{i}.json").write_text(text)
    schema = spark.createDataFrame([], "a long").schema
    assert sorted(r.a for r in read_json_array(spark, str(tmp_path), schema).collect()) == [1, 2, 3, 4, 5, 6]


def test_one_large_array_is_read_by_several_tasks(spark, tmp_path):
    n = 150_000
    with open(tmp_path / "big.json", "w") as f:
        f.write("[")
        for i in range(n):
            f.write(("," if i else "") + '{"a": %d, "b": "%s"}' % (i, "x{}" * (i % 50)))
        f.write("]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        got = read_json_array(spark, str(tmp_path / "big.json"), spark.createDataFrame([], "a long, b string").schema)
        r = got.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum(F.length("b")).alias("b")).first()
        assert (r.n, r.a, r.b) == (n, n * (n - 1) // 2, sum(3 * (i % 50) for i in range(n)))
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "big.json")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dictionary_lines_keep_their_order_over_splits_and_files(spark, tmp_path):
    from admitlens.sources.records import read_dictionary

    lines = [f"  Name {i}\t" if i % 9 else "   " for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("last one\r\n\r\nand another\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = read_dictionary(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.name for r in got] == [x.strip() for x in lines if x.strip()] + ["last one", "and another"]
    assert [r.pos - (1 << 32) for r in got[:3]] == [1, 2, 3] and [r.pos - (2 << 32) for r in got[-2:]] == [0, 2]


def test_arrays_are_written_without_a_shuffle(spark, tmp_path):
    from admitlens.sources import records as S

    df = spark.range(0, 5300, 1, 3).selectExpr("id AS a", "IF(id % 2 = 0, NULL, concat('\"', id)) AS b")
    S.write_records(df, str(tmp_path / "out"))
    sizes = [len(json.loads(r.value)) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sum(sizes) == 5300 and max(sizes) == S.ARRAY_CHUNK_ROWS and len(sizes) == 6
    back = S.read_records(spark, str(tmp_path / "out"), df.schema)
    assert back.count() == 5300 and back.exceptAll(df).count() == 0
    S.write_records(df.where("false"), str(tmp_path / "none"))
    assert S.read_records(spark, str(tmp_path / "none"), df.schema).count() == 0
