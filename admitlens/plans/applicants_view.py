"""AV: an applicants table derived from orders ⋈ customer ⋈ nation ⋈ region.

One row per order. The Spark side is built with the DataFrame API (size-checked
broadcast of the nation⋈region dimension; the orders⋈customer join is left to
the optimizer/AQE since both sides grow with the data). ``AV_SQL`` is an
independent SQL text of the same view, used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from admitlens.schema import APPLICANT_COLUMNS
from admitlens.session import read_table

# Fixed values of the fixture: university by c_nationkey % 8.
UNIVERSITY_BY_NATION_MOD8 = [
    "Johns Hopkins University",
    "Stanford University",
    "MIT",
    "Carnegie Mellon University",
    "Smith College",
    "Georgetown University",
    "Massachusetts Institute of Technology",
    "University of Toronto",
]


def _university(nationkey: Column) -> Column:
    return F.element_at(F.array(*[F.lit(u) for u in UNIVERSITY_BY_NATION_MOD8]),
                        (nationkey % 8 + 1).cast("int"))


def _raw_program(segment: Column) -> Column:
    return (F.when(segment.isin("FURNITURE", "MACHINERY"), "Computer Science")
            .when(segment == "BUILDING", "Mathematics")
            .when(segment == "AUTOMOBILE", "Information Studies")
            .otherwise("Economics"))


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation ⋈ region reduced to what the view needs per customer."""
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # No hints: scan sizes decide, and AQE decides again from real sizes.
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    prof = customer.join(dim, customer.c_nationkey == dim.n_nationkey)
    return prof.select(
        "c_custkey",
        _university(F.col("c_nationkey")).alias("university"),
        _raw_program(F.col("c_mktsegment")).alias("raw_program"),
        (F.when(F.col("r_name") == "AMERICA", "American")
         .when(F.col("r_name").isin("ASIA", "EUROPE"), "International")
         .when(F.col("r_name") == "AFRICA", "Other")).alias("citizenship"),
    )


def applicant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view before the table-level combine: university and raw program are
    still separate (record shape), plus every table column."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    prof = customer_profile(spark, sf_dir)
    j = orders.join(prof, orders.o_custkey == prof.c_custkey)
    k = F.col("o_orderkey")
    odate = F.col("o_orderdate").cast("date")
    uni = F.col("university")
    return j.select(
        k.cast("bigint").alias("p_id"),
        uni.alias("university"),
        F.col("raw_program"),
        F.concat_ws(" - ", uni, F.col("raw_program")).alias("program"),
        (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "PhD")
         .when(F.col("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED"), "Masters")
         .otherwise("Other")).alias("degreeType"),
        odate.alias("datePosted"),
        (F.when(F.col("o_orderstatus") == "F", "Accepted")
         .when(F.col("o_orderstatus") == "O", "Rejected")
         .when(F.col("o_orderstatus") == "P", "Wait listed")).alias("status"),
        F.lit(None).cast("string").alias("statusDate"),
        F.concat(F.when(F.month(odate) <= 6, "Fall").otherwise("Spring"), F.lit(" "),
                 (F.year(odate) + 25).cast("string")).alias("semester"),
        F.col("citizenship"),
        F.when(k % 5 != 0, 2.0 + ((k * 37) % 201).cast("double") / 100).alias("gpa"),
        F.when(k % 3 != 0, (130 + k % 41).cast("double")).alias("gre"),
        F.when(k % 4 != 0, (130 + (k * 7) % 41).cast("double")).alias("gre_v"),
        F.when(k % 6 != 0, (k % 13) / 2.0).alias("gre_aw"),
        F.lit(None).cast("string").alias("comment"),
        F.concat(F.lit("https://example.test/result/"), k.cast("string")).alias("url"),
        F.col("raw_program").alias("llm_generated_program"),
        (F.when(uni == "MIT", "Massachusetts Institute of Technology")
         .when(uni == "Smith College", "Unknown").otherwise(uni)).alias("llm_generated_university"),
    )


def applicants_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AV with exactly the applicants-table columns."""
    return applicant_records(spark, sf_dir).select(*APPLICANT_COLUMNS)


# Independent SQL text of the same view (DuckDB oracle side).
_UNI_CASE = "CASE c.c_nationkey % 8 " + " ".join(
    f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNIVERSITY_BY_NATION_MOD8)) + " END"
_PROG_CASE = ("CASE WHEN c.c_mktsegment IN ('FURNITURE','MACHINERY') THEN 'Computer Science' "
              "WHEN c.c_mktsegment = 'BUILDING' THEN 'Mathematics' "
              "WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Information Studies' "
              "ELSE 'Economics' END")

AV_RECORDS_SQL = f"""
SELECT CAST(o.o_orderkey AS BIGINT) AS p_id,
       {_UNI_CASE} AS university,
       {_PROG_CASE} AS raw_program,
       {_UNI_CASE} || ' - ' || {_PROG_CASE} AS program,
       CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'PhD'
            WHEN o.o_orderpriority IN ('3-MEDIUM','4-NOT SPECIFIED') THEN 'Masters'
            ELSE 'Other' END AS degreeType,
       CAST(o.o_orderdate AS DATE) AS datePosted,
       CASE o.o_orderstatus WHEN 'F' THEN 'Accepted' WHEN 'O' THEN 'Rejected'
            WHEN 'P' THEN 'Wait listed' END AS status,
       CAST(NULL AS VARCHAR) AS statusDate,
       CASE WHEN month(o.o_orderdate) <= 6 THEN 'Fall' ELSE 'Spring' END || ' '
            || CAST(year(o.o_orderdate) + 25 AS VARCHAR) AS semester,
       CASE WHEN r.r_name = 'AMERICA' THEN 'American'
            WHEN r.r_name IN ('ASIA','EUROPE') THEN 'International'
            WHEN r.r_name = 'AFRICA' THEN 'Other' END AS citizenship,
       CASE WHEN o.o_orderkey % 5 <> 0
            THEN 2.0 + CAST((o.o_orderkey * 37) % 201 AS DOUBLE) / 100 END AS gpa,
       CASE WHEN o.o_orderkey % 3 <> 0 THEN CAST(130 + o.o_orderkey % 41 AS DOUBLE) END AS gre,
       CASE WHEN o.o_orderkey % 4 <> 0 THEN CAST(130 + (o.o_orderkey * 7) % 41 AS DOUBLE) END AS gre_v,
       CASE WHEN o.o_orderkey % 6 <> 0 THEN CAST(o.o_orderkey % 13 AS DOUBLE) / 2.0 END AS gre_aw,
       CAST(NULL AS VARCHAR) AS comment,
       'https://example.test/result/' || CAST(o.o_orderkey AS VARCHAR) AS url,
       {_PROG_CASE} AS llm_generated_program,
       CASE {_UNI_CASE} WHEN 'MIT' THEN 'Massachusetts Institute of Technology'
            WHEN 'Smith College' THEN 'Unknown' ELSE {_UNI_CASE} END AS llm_generated_university
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

AV_SQL = "SELECT " + ", ".join(APPLICANT_COLUMNS) + " FROM (" + AV_RECORDS_SQL + ") rec"


def with_av(body: str) -> str:
    """Oracle helper: ``body`` may refer to ``av`` and ``av_rec``."""
    return f"WITH av_rec AS ({AV_RECORDS_SQL}), av AS (SELECT {', '.join(APPLICANT_COLUMNS)} FROM av_rec)\n{body}"
