"""Fixed schemas: the applicants table and the (loosely typed) record."""

from __future__ import annotations

from pyspark.sql import types as T

# The applicants table: 16 scalar columns, key ``p_id``.
APPLICANTS = T.StructType([
    T.StructField("p_id", T.LongType(), True),
    T.StructField("program", T.StringType(), True),
    T.StructField("degreeType", T.StringType(), True),
    T.StructField("datePosted", T.DateType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("statusDate", T.StringType(), True),
    T.StructField("semester", T.StringType(), True),
    T.StructField("citizenship", T.StringType(), True),
    T.StructField("gpa", T.DoubleType(), True),
    T.StructField("gre", T.DoubleType(), True),
    T.StructField("gre_v", T.DoubleType(), True),
    T.StructField("gre_aw", T.DoubleType(), True),
    T.StructField("comment", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("llm_generated_program", T.StringType(), True),
    T.StructField("llm_generated_university", T.StringType(), True),
])
APPLICANT_COLUMNS = [f.name for f in APPLICANTS.fields]

# Every key spelling seen for a record field, in order of
# preference (first present, non-null one wins).
KEY_SPELLINGS: dict[str, list[str]] = {
    "applicant_number": ["applicantNumber", "applicant_number", "p_id"],
    "university": ["university"],
    "program": ["program"],
    "degree_type": ["degreeType", "degree_type", "Degree"],
    "date_posted": ["datePosted", "date_posted", "date_added"],
    "status": ["status"],
    "status_date": ["statusDate", "status_date"],
    "semester": ["semester", "term"],
    "citizenship": ["citizenship", "US/International"],
    "gpa": ["gpa", "GPA"],
    "gre": ["gre"],
    "gre_v": ["gre_v"],
    "gre_aw": ["gre_aw"],
    "comment": ["comment", "comments"],
    "url": ["url"],
    "llm_generated_program": ["llm_generated_program", "llm-generated-program"],
    "llm_generated_university": ["llm_generated_university", "llm-generated-university"],
}

# Records read from JSON text: a map keeps spellings that differ in case only.
RECORD_MAP = T.MapType(T.StringType(), T.StringType())

# Watermarks: one row per source.
WATERMARKS = T.StructType([
    T.StructField("source", T.StringType(), True),
    T.StructField("last_seen", T.StringType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])
