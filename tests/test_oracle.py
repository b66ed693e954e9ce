"""Every registered query against its DuckDB oracle (sf0.001), and a
rows-only smoke run for the ones without SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from admitlens.plans import registry
from helpers import rows_key

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# A query for every operator of the survey (its predicates P1-P6 and U2 stand inside them).
SURVEY_QUERIES = """
term_count citizenship_pct average_scores term_citizen_gpa term_acceptance_pct term_accepted_gpa
school_program_degree_count top_school_acceptances top_school_acceptances_std rejection_rate_by_term
gpa_by_outcome scalar_bundle run_all order_limit format_report report_json answer_set read_records
write_records read_envelope read_json_array write_jsonl read_dictionary applicants_table chunked_write_merge
conform parse_date combine_names dedupe_first insert_ignore reject_invalid load_stats load_batch clean_text
split_program_university expand_abbreviation apply_fixes title_case lower_of canonical_lookup fuzzy_match
normalize_program normalize_university json_from_chatter build_prompts enrich enrich_model explode_elements
mark_record_start main_row_fields stitch_followers split_status_date resolve_url classify_badges
parse_prefixed_number extract_comment extract_listing extraction_issues scan_pages new_by_url page_novelty
stop_at_seen_page number_rows advance_watermark incremental_update full_build encode_tasks decode_tasks
route_tasks dead_letters handle_ingest handle_refresh paced_consume
"""

SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "DateType()": "DATE", "BooleanType()": "BOOLEAN",
                 "TimestampNTZType()": "TIMESTAMP"}

entry.queries()      # imports every plan
QUERIES = dict(registry.QUERIES)
ORACLE = dict(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_every_survey_operator_is_registered():
    missing = set(SURVEY_QUERIES.split()) - set(QUERIES)
    assert not missing
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf_small, duck, name):
    df = QUERIES[name](spark, sf_small)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType))
            for f in df.schema.fields} == types
    cur = duck.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert rows_key(df.columns, rows) == rows_key(ocols, orows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    assert df.count() >= 1


def test_entry_flagship(spark):
    rows = entry.entry(spark).collect()
    # sf0.001: Spring/Fall 2025/2026, semester descending
    assert [r["semester"] for r in rows] == ["Spring 2026", "Spring 2025", "Fall 2026", "Fall 2025"]
    assert [r["total"] for r in rows] == [15, 46, 30, 38]
    assert [r["rejections"] for r in rows] == [3, 15, 14, 17]
