"""Registered queries: sources/sinks (S1–S7) and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.functions.dates import parse_date
from admitlens.functions.records import combine_names
from admitlens.operators import load as L
from admitlens.plans.applicants_view import applicant_records, applicants_view, with_av
from admitlens.plans.registry import register
from admitlens.schema import APPLICANT_COLUMNS, APPLICANTS, RECORD_MAP
from admitlens.session import read_table, scratch_path
from admitlens.sources import records as S
from admitlens.sources.tables import ApplicantsTable

AV_COLS = ", ".join(APPLICANT_COLUMNS)


# ----------------------------------------------------------------- S1 / S3
@register("read_records", with_av("SELECT * FROM av"))
def q_read_records(spark, sf):
    """AV written as JSON arrays (S3 array format), read back by S1."""
    path = scratch_path(spark, "records")
    S.write_records(applicants_view(spark, sf), path, fmt="json_array")
    return S.read_records(spark, path, APPLICANTS)


@register("write_records", with_av("SELECT * FROM av"))
def q_write_records(spark, sf):
    """S3 twice into the same target (replace semantics), read back once."""
    path = scratch_path(spark, "records")
    av = applicants_view(spark, sf)
    S.write_records(av.filter(F.col("status") == "Accepted"), path, fmt="json")
    S.write_records(av, path, fmt="json")
    return S.read_records(spark, path, APPLICANTS)


# ----------------------------------------------------------------- S2
def _envelopes(spark, sf) -> DataFrame:
    """AV rows packed 50 to a JSON text: a bare list, a {"rows": …} envelope,
    an unknown envelope or broken text, by group number."""
    av = applicants_view(spark, sf).select("p_id", "program", "status")
    g = F.floor(F.col("p_id") / 50)
    packed = av.groupBy(g.alias("grp")).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("p_id", "program", "status"))))
        .alias("arr"))
    grp = F.col("grp")
    text = (F.when(grp % 11 == 5, F.concat(F.lit("{broken "), F.col("arr")))
            .when(grp % 7 == 3, F.concat(F.lit('{"data": '), F.col("arr"), F.lit("}")))
            .when(grp % 2 == 0, F.col("arr"))
            .otherwise(F.concat(F.lit('{"rows": '), F.col("arr"), F.lit("}"))))
    return packed.select("grp", text.alias("body"))


_ENV_SCHEMA = T.StructType([T.StructField("p_id", T.LongType()),
                            T.StructField("program", T.StringType()),
                            T.StructField("status", T.StringType())])


@register("read_envelope", with_av(
    "SELECT p_id, program, status FROM av WHERE NOT (floor(p_id / 50) % 11 = 5) "
    "AND NOT (floor(p_id / 50) % 7 = 3)"))
def q_read_envelope(spark, sf):
    return S.read_envelope(_envelopes(spark, sf), "body", _ENV_SCHEMA).drop("grp")


@register("read_json_array", with_av("SELECT p_id, program, status FROM av"))
def q_read_json_array(spark, sf):
    """S1 for files that hold one array each, over many lines: every task of the writer
    makes an array of its rows, and many tasks read each."""
    rows = applicants_view(spark, sf).select("p_id", "program", "status")
    text = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))

    def array(batches):
        import pyarrow as pa

        mark = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([(mark if i == 0 else ",") + x for i, x in enumerate(lines)])], names=["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    path = scratch_path(spark, "json-array")
    text.mapInArrow(array, "value string").write.text(path)
    return S.read_records(spark, path, rows.schema, multiline=True)


# ----------------------------------------------------------------- S4
@register("write_jsonl", with_av("SELECT * FROM av UNION ALL SELECT * FROM av"))
def q_write_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    av = applicants_view(spark, sf)
    S.write_jsonl(av, path, append=False)
    S.write_jsonl(av, path, append=True)
    return spark.read.schema(APPLICANTS).json(path)


# ----------------------------------------------------------------- S5
@register("read_dictionary",
          "SELECT trim(p_name) AS name FROM part WHERE p_partkey % 10 <> 0 AND trim(p_name) <> ''")
def q_read_dictionary(spark, sf):
    """Part names written as padded text lines (every tenth line blank)."""
    path = scratch_path(spark, "dictionary")
    part = read_table(spark, sf, "part")
    line = F.when(F.col("p_partkey") % 10 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t")))
    part.select(line.alias("value")).write.mode("overwrite").text(path)
    return S.read_dictionary(spark, path).select("name")


# ----------------------------------------------------------------- S6
@register("applicants_table", with_av("SELECT * FROM av"))
def q_applicants_table(spark, sf):
    table = ApplicantsTable(spark, scratch_path(spark, "applicants"))
    table.ensure()
    table.ensure()
    table.append(applicants_view(spark, sf))
    return table.scan()


# ----------------------------------------------------------------- S7
@register("chunked_write_merge", with_av(
    f"SELECT {AV_COLS}, CAST(LEAST(floor((ROW_NUMBER() OVER (ORDER BY p_id) - 1) / "
    "floor((SELECT COUNT(*) FROM av) / 4)), 3) AS INTEGER) AS chunk FROM av"))
def q_chunked_write_merge(spark, sf):
    out = S.chunked_write_merge(applicants_view(spark, sf), 4, scratch_path(spark, "chunks"),
                                order=["p_id"])
    return out.select(*APPLICANT_COLUMNS, F.col("chunk").cast("int"))


# ----------------------------------------------------------------- L1
def _mixed_records(spark, sf) -> DataFrame:
    """AV records as JSON text under three key spellings (by key mod 3)."""
    r = applicant_records(spark, sf)
    k = F.col("p_id")
    date_txt = F.date_format("datePosted", "MMM d, yyyy")
    camel = F.to_json(F.struct(
        k.alias("applicantNumber"), "university", F.col("raw_program").alias("program"),
        "degreeType", date_txt.alias("datePosted"), "status", "statusDate", "semester",
        "citizenship", "gpa", "gre", "gre_v", "gre_aw", "comment", "url",
        F.col("llm_generated_program").alias("llm-generated-program"),
        F.col("llm_generated_university").alias("llm-generated-university")))
    snake = F.to_json(F.struct(
        k.alias("applicant_number"), "university", F.col("raw_program").alias("program"),
        F.col("degreeType").alias("degree_type"), date_txt.alias("date_posted"), "status",
        F.col("statusDate").alias("status_date"), "semester", "citizenship",
        F.col("gpa").cast("string").alias("gpa"), "gre", "gre_v", "gre_aw", "comment", "url",
        "llm_generated_program", "llm_generated_university"))
    alt = F.to_json(F.struct(
        k.cast("string").alias("p_id"), "university", F.col("raw_program").alias("program"),
        F.col("degreeType").alias("Degree"), date_txt.alias("date_added"), "status",
        F.col("semester").alias("term"), F.col("citizenship").alias("US/International"),
        F.concat(F.lit("GPA "), F.col("gpa").cast("string")).alias("GPA"), "gre", "gre_v",
        "gre_aw", F.col("comment").alias("comments"), "url",
        "llm_generated_program", "llm_generated_university"))
    body = F.when(k % 3 == 0, camel).when(k % 3 == 1, snake).otherwise(alt)
    return r.select(F.from_json(body, RECORD_MAP).alias("rec"))


@register("conform", with_av("SELECT * FROM av"))
def q_conform(spark, sf):
    return L.conform(_mixed_records(spark, sf), map_col="rec").select(*APPLICANT_COLUMNS)


# ----------------------------------------------------------------- L2
_DATE_VARIANT_SQL = """
WITH d AS (SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS dt,
                  strftime(o_orderdate, '%b') AS mon, CAST(day(o_orderdate) AS VARCHAR) AS dd,
                  CAST(year(o_orderdate) AS VARCHAR) AS yy, o_orderkey % 8 AS v FROM orders)
SELECT o_orderkey,
  CASE v WHEN 0 THEN mon || ' ' || dd || ', ' || yy
         WHEN 1 THEN lower(mon) || ' ' || dd || ', ' || yy
         WHEN 2 THEN '  ' || mon || '  ' || dd || ',  ' || yy || ' '
         WHEN 3 THEN strftime(o_orderdate, '%B') || ' ' || dd || ', ' || yy
         WHEN 4 THEN mon || ' ' || dd || ',' || yy
         WHEN 5 THEN ''
         WHEN 6 THEN 'Feb 30, ' || yy
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
  CASE WHEN v IN (0, 1, 2) THEN dt WHEN v = 3 AND month(dt) = 5 THEN dt END AS parsed
FROM d"""


@register("parse_date", _DATE_VARIANT_SQL)
def q_parse_date(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    mon = F.date_format("o_orderdate", "MMM")
    dd = F.dayofmonth("o_orderdate").cast("string")
    yy = F.year("o_orderdate").cast("string")
    v = F.col("o_orderkey") % 8
    text = (F.when(v == 0, F.concat_ws("", mon, F.lit(" "), dd, F.lit(", "), yy))
            .when(v == 1, F.concat_ws("", F.lower(mon), F.lit(" "), dd, F.lit(", "), yy))
            .when(v == 2, F.concat_ws("", F.lit("  "), mon, F.lit("  "), dd, F.lit(",  "), yy, F.lit(" ")))
            .when(v == 3, F.concat_ws("", F.date_format("o_orderdate", "MMMM"), F.lit(" "), dd,
                                      F.lit(", "), yy))
            .when(v == 4, F.concat_ws("", mon, F.lit(" "), dd, F.lit(","), yy))
            .when(v == 5, F.lit(""))
            .when(v == 6, F.concat(F.lit("Feb 30, "), yy))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select("o_orderkey", text.alias("date_text")).withColumn(
        "parsed", parse_date(F.col("date_text")))


# ----------------------------------------------------------------- L3
@register("combine_names", """
SELECT c.c_custkey,
  CASE c.c_custkey % 4 WHEN 0 THEN n.n_name || ' - ' || c.c_mktsegment
                       WHEN 1 THEN c.c_mktsegment
                       WHEN 2 THEN n.n_name END AS combined
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_combine_names(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    m = F.col("c_custkey") % 4
    u = F.when(m == 1, F.lit("")).when(m == 3, F.lit("")).otherwise(F.col("n_name"))
    p = F.when(m == 2, F.lit(None).cast("string")).when(m == 3, F.lit(None).cast("string")) \
        .otherwise(F.col("c_mktsegment"))
    return j.select("c_custkey", combine_names(u, p).alias("combined"))


# ----------------------------------------------------------------- L4
@register("dedupe_first", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST,
    l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST,
    l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
    l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS rn
  FROM lineitem) t WHERE rn = 1""")
def q_dedupe_first(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return L.dedupe_first(li, "l_orderkey", "l_linenumber").select(*li.columns)


# ----------------------------------------------------------------- L5
_OLD = "datePosted < DATE '1996-01-01'"
_NEW = "TRUE"      # the batch is every order


def _split(spark, sf):
    av = applicants_view(spark, sf)
    target = av.filter(F.col("datePosted") < F.lit("1996-01-01").cast("date"))
    batch = av.withColumn("status", F.concat(F.col("status"), F.lit(" (again)")))
    return target, batch


@register("insert_ignore", with_av(
    f"SELECT * FROM av WHERE {_OLD} UNION ALL "
    f"SELECT p_id, program, degreeType, datePosted, status || ' (again)', statusDate, semester, "
    "citizenship, gpa, gre, gre_v, gre_aw, comment, url, llm_generated_program, "
    f"llm_generated_university FROM av WHERE {_NEW} AND NOT ({_OLD})"))
def q_insert_ignore(spark, sf):
    target, batch = _split(spark, sf)
    return target.unionByName(L.insert_ignore(target, batch, "p_id"))


# ----------------------------------------------------------------- L6
def _dirty_records(spark, sf) -> DataFrame:
    """AV records with broken keys / scores injected (by key residue), plus a
    second copy of every tenth record marked as a duplicate."""
    r = applicant_records(spark, sf)
    k = F.col("p_id")
    key = (F.when(k % 13 == 0, F.lit(None).cast("string"))
           .when(k % 17 == 0, F.concat(F.lit("x"), k.cast("string")))
           .otherwise(k.cast("string")))
    gpa = F.when(k % 19 == 0, F.lit("abc")).otherwise(F.col("gpa").cast("string"))
    rec = r.select(
        key.alias("applicant_number"), "university", F.col("raw_program").alias("program"),
        F.col("degreeType").alias("degree_type"),
        F.date_format("datePosted", "MMM d, yyyy").alias("date_posted"), "status", "semester",
        "citizenship", gpa.alias("gpa"), "gre", "gre_v", "gre_aw", "url",
        "llm_generated_program", "llm_generated_university")
    rec = rec.withColumn("copy", F.lit(1))
    dups = rec.filter(k % 10 == 0).withColumn("status", F.lit("DUPLICATE")).withColumn("copy", F.lit(2))
    return rec.unionByName(dups)


_DIRTY_SQL = f"""
rec AS (SELECT p_id, CASE WHEN p_id % 13 = 0 THEN 'missing_key' WHEN p_id % 17 = 0 THEN 'bad_key'
                     WHEN p_id % 19 = 0 THEN 'bad_number:gpa' END AS reject_reason,
               CASE WHEN p_id % 13 = 0 THEN NULL WHEN p_id % 17 = 0 THEN 'x' || CAST(p_id AS VARCHAR)
                    ELSE CAST(p_id AS VARCHAR) END AS raw_key, 1 AS copies
        FROM av WHERE {_NEW}
        UNION ALL
        SELECT p_id, CASE WHEN p_id % 13 = 0 THEN 'missing_key' WHEN p_id % 17 = 0 THEN 'bad_key'
                     WHEN p_id % 19 = 0 THEN 'bad_number:gpa' END,
               CASE WHEN p_id % 13 = 0 THEN NULL WHEN p_id % 17 = 0 THEN 'x' || CAST(p_id AS VARCHAR)
                    ELSE CAST(p_id AS VARCHAR) END, 2
        FROM av WHERE {_NEW} AND p_id % 10 = 0)"""


@register("reject_invalid", with_av(f""", {_DIRTY_SQL.strip()}
SELECT raw_key, reject_reason FROM rec WHERE reject_reason IS NOT NULL"""))
def q_reject_invalid(spark, sf):
    _, rejects = L.reject_invalid(L.conform(_dirty_records(spark, sf)))
    return rejects.select(F.col("_raw_key").alias("raw_key"), "reject_reason")


_STATS_SQL = f""", {_DIRTY_SQL.strip()},
valid AS (SELECT DISTINCT p_id FROM rec WHERE reject_reason IS NULL),
ins AS (SELECT COUNT(*) AS n FROM valid WHERE p_id NOT IN (SELECT p_id FROM av WHERE {_OLD}))
SELECT CAST((SELECT n FROM ins) AS BIGINT) AS inserted,
       CAST(COUNT(*) FILTER (WHERE reject_reason IS NULL) - (SELECT n FROM ins) AS BIGINT) AS skipped,
       CAST(COUNT(*) FILTER (WHERE reject_reason IS NOT NULL) AS BIGINT) AS rejected
FROM rec"""


@register("load_stats", with_av(_STATS_SQL))
def q_load_stats(spark, sf):
    target, _ = _split(spark, sf)
    flagged, new_rows = L.prepare_batch(_dirty_records(spark, sf), target, order_cols=["copy"])
    return L.load_stats(flagged, new_rows)


_LOADED_SQL = f""", {_DIRTY_SQL.strip()}
SELECT * FROM av WHERE {_OLD}
UNION ALL
SELECT * FROM av WHERE {_NEW} AND NOT ({_OLD})
  AND p_id IN (SELECT p_id FROM rec WHERE reject_reason IS NULL)"""


@register("load_batch", with_av(_LOADED_SQL))
def q_load_batch(spark, sf):
    """Table holds the old rows; the dirty batch is loaded twice (idempotent)."""
    table = ApplicantsTable(spark, scratch_path(spark, "applicants"))
    target, _ = _split(spark, sf)
    table.append(target)
    batch = _dirty_records(spark, sf)
    L.load_batch(table, batch, order_cols=["copy"]).collect()
    L.load_batch(table, batch, order_cols=["copy"]).collect()
    return table.scan()
