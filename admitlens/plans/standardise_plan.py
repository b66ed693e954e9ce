"""Registered queries: standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from admitlens.fixed_values import WS_CLASS
from admitlens.functions.text import (
    clean_text,
    json_from_chatter,
    lower_of,
    split_program_university,
    title_case,
)
from admitlens.operators import normalize as N
from admitlens.operators.fuzzy import fuzzy_match
from admitlens.plans.applicants_view import applicant_records, with_av
from admitlens.plans.registry import register
from admitlens.session import read_table, shuffled


def duck_title(x: str) -> str:
    """Python str.title() on ASCII text, as DuckDB SQL (oracle side)."""
    return (f"list_aggregate(list_transform(regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)'), "
            "lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z]') THEN upper(left(w, 1)) || "
            "lower(substr(w, 2)) ELSE w END), 'string_agg', '')")


# ----------------------------------------------------------------- N1
@register("clean_text", f"""
SELECT doc_id, regexp_replace(trim(regexp_replace(coalesce(text, ''), '{WS_CLASS}+', ' ', 'g')),
                              '^,+|,+$', '', 'g') AS cleaned
FROM documents""")
def q_clean_text(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", clean_text(F.col("text")).alias("cleaned"))


# ----------------------------------------------------------------- N2
def _program_university_text(spark, sf):
    r = applicant_records(spark, sf).select("p_id", "university", "raw_program")
    k = F.col("p_id")
    sep = F.when(k % 3 == 0, F.lit(",  ")).when(k % 3 == 1, F.lit(" at ")).otherwise(F.lit(" @ "))
    txt = F.when(k % 5 == 0, F.concat(F.lit(" "), F.col("raw_program"), F.lit(" ,"))) \
        .otherwise(F.concat(F.col("raw_program"), sep, F.col("university"), F.lit("\t")))
    txt = F.when(k % 7 == 0, F.lower(txt)).otherwise(txt)
    return r.select("p_id", txt.alias("text"))


@register("split_program_university", with_av("""
SELECT p_id, raw_program AS program,
  CASE WHEN p_id % 5 = 0 THEN 'Unknown' WHEN university = 'MIT' THEN 'Mit'
       ELSE university END AS university
FROM av_rec"""))
def q_split_program_university(spark, sf):
    t = _program_university_text(spark, sf)
    return t.select("p_id", split_program_university(F.col("text")).alias("s")).select(
        "p_id", "s.program", "s.university")


# ----------------------------------------------------------------- N3
SEGMENT_RULES = [
    (r"(?i)^(bldg|b\.?l\.?d\.?g\.?)$", "BUILDING"),
    (r"(?i)^auto(mobile)?\.?$", "AUTOMOBILE"),
    (r"(?i)^furn(\.|iture)?$", "FURNITURE"),
    (r"(?i)^mach(\.|inery)?$", "MACHINERY"),
    (r"(?i)^h\.?h\.?$", "HOUSEHOLD"),
]
_CODES = {"BUILDING": ["BLDG", "b.l.d.g.", "Bldg"], "AUTOMOBILE": ["AUTO", "auto.", "Automobile"],
          "FURNITURE": ["FURN", "furn.", "Furniture"], "MACHINERY": ["MACH", "mach.", "Machinery"],
          "HOUSEHOLD": ["HH", "h.h.", "Hh"]}


@register("expand_abbreviation", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '?' || c_mktsegment ELSE c_mktsegment END
  AS segment FROM customer""")
def q_expand_abbreviation(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    v = (F.col("c_custkey") % 4).cast("int")
    code = F.col("c_mktsegment")
    for seg, variants in _CODES.items():
        code = F.when((F.col("c_mktsegment") == seg) & (v < 3),
                      F.element_at(F.array(*[F.lit(x) for x in variants]), v + 1)).otherwise(code)
    code = F.when(v == 3, F.concat(F.lit("?"), F.col("c_mktsegment"))).otherwise(code)
    return c.select("c_custkey", N.expand_abbreviation(code, SEGMENT_RULES).alias("segment"))


# ----------------------------------------------------------------- N4
@register("apply_fixes", with_av("SELECT p_id, llm_generated_university AS university FROM av_rec"))
def q_apply_fixes(spark, sf):
    r = applicant_records(spark, sf)
    fixes = {"MIT": "Massachusetts Institute of Technology", "Smith College": "Unknown"}
    return r.select("p_id", N.apply_fixes(F.col("university"), fixes).alias("university"))


# ----------------------------------------------------------------- N5 / N6
def duck_title_unicode(x: str) -> str:
    """Python str.title() over cased letters, as DuckDB SQL. A word starting
    with ß titles as 'Ss' (DuckDB's upper gives the capital sharp s)."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return (f"list_aggregate(list_transform(regexp_extract_all({x}, '([{cased}]+|[^{cased}]+)'), "
            f"lambda w: CASE WHEN left(w, 1) = 'ß' THEN 'Ss' || lower(substr(w, 2)) "
            f"WHEN regexp_matches(w, '^[{cased}]') THEN upper(left(w, 1)) || "
            "lower(substr(w, 2)) ELSE w END), 'string_agg', '')")


@register("title_case", f"""
SELECT 'part' AS source, p_partkey AS id, {duck_title('p_name')} AS title FROM part
UNION ALL
SELECT 'document', doc_id, {duck_title_unicode('text')} FROM documents""")
def q_title_case(spark, sf):
    """Part names and whole documents (four languages) title-cased."""
    p = read_table(spark, sf, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("id"),
        title_case(F.col("p_name")).alias("title"))
    d = read_table(spark, sf, "documents").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"),
        title_case(F.col("text")).alias("title"))
    return p.unionByName(d)


@register("lower_of", with_av(
    f"SELECT p_id, regexp_replace({duck_title('lower(university)')}, '\\bOf\\b', 'of', 'g') "
    "AS university FROM av_rec"))
def q_lower_of(spark, sf):
    r = applicant_records(spark, sf)
    return r.select("p_id", lower_of(title_case(F.lower(F.col("university")))).alias("university"))


# ----------------------------------------------------------------- N7
@register("canonical_lookup", f"""
WITH d AS (SELECT DISTINCT {duck_title('p_name')} AS name FROM part WHERE p_size <= 25)
SELECT p.p_partkey, {duck_title('p.p_name')} AS title, d.name IS NOT NULL AS is_canonical
FROM part p LEFT JOIN d ON {duck_title('p.p_name')} = d.name""")
def q_canonical_lookup(spark, sf):
    p = read_table(spark, sf, "part")
    titled = p.select("p_partkey", title_case(F.col("p_name")).alias("title"))
    d = p.filter(F.col("p_size") <= 25).select(title_case(F.col("p_name")).alias("name"))
    return N.canonical_lookup(titled, "title", d)


# ----------------------------------------------------------------- N8
def _typo(c):
    """Drop the second character (a typical typo) of every third name."""
    return F.concat(F.substring(c, 1, 1), F.substring(c, F.lit(3), F.length(c)))


# Names of real cardinality: 32 random letters per customer, so that the best
# entry of a name is known: a name with a letter dropped is 31 of 32 letters its
# own entry's and no other's.
_CODE_SQL = "translate(md5({0}), '0123456789', 'ghijklmnop')"
_C = _CODE_SQL.format("CAST(c_custkey AS VARCHAR)")
_STRANGE = _CODE_SQL.format("'x' || CAST(c_custkey AS VARCHAR)")
_CASE = "CASE c_custkey % 3 WHEN 0 THEN 'typo' WHEN 1 THEN 'same' ELSE 'strange' END"


def _code(c):
    return F.translate(F.md5(c.cast("binary")), "0123456789", "ghijklmnop")


def _coded(spark, sf):
    """(c_custkey, entry, query): a typo, the entry itself, or a strange name."""
    key = F.col("c_custkey").cast("string")
    c = read_table(spark, sf, "customer").select("c_custkey", _code(key).alias("entry"),
                                                 _code(F.concat(F.lit("x"), key)).alias("strange"))
    v = F.col("c_custkey") % 3
    return c.select("c_custkey", "entry", F.when(v == 0, _typo(F.col("entry"))).when(v == 1, F.col("entry"))
                    .otherwise(F.col("strange")).alias("query"))


@register("fuzzy_match", f"""
SELECT c_custkey, CASE {_CASE} WHEN 'typo' THEN left({_C}, 1) || substr({_C}, 3) WHEN 'same' THEN {_C} ELSE {_STRANGE} END AS query,
  CASE {_CASE} WHEN 'strange' THEN NULL ELSE {_C} END AS match,
  CASE {_CASE} WHEN 'typo' THEN CAST(62 AS DOUBLE) / 63 WHEN 'same' THEN CAST(1 AS DOUBLE) END AS score
FROM customer""")
def q_fuzzy_match(spark, sf):
    c = _coded(spark, sf)
    m = fuzzy_match(c, "query", c.select(F.col("entry").alias("name")), 0.84)
    return c.join(shuffled(m), "query", "left").select("c_custkey", "query", "match", "score")


# ----------------------------------------------------------------- N9 / N10
def _title(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def _titled_sql(x: str) -> str:
    return f"upper(left({x}, 1)) || substr({x}, 2)"


_NORMAL_SQL = f"""
SELECT c_custkey, CASE {_CASE} WHEN 'strange' THEN {_titled_sql(_STRANGE)} ELSE {_titled_sql(_C)} END AS name FROM customer
"""


@register("normalize_program", _NORMAL_SQL)
def q_normalize_program(spark, sf):
    """Lower-case names with typos against a dictionary of title-case names."""
    c = _coded(spark, sf)
    return N.normalize_program(c.select("c_custkey", F.concat(F.lit("  "), F.col("query")).alias("name")), "name",
                               c.select(_title(F.col("entry")).alias("name")))


@register("normalize_university", _NORMAL_SQL.replace("SELECT c_custkey, CASE", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE CASE")
          .replace(" END AS name", " END END AS name"))
def q_normalize_university(spark, sf):
    """The same in capitals, and some without a name."""
    c = _coded(spark, sf)
    name = F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.upper(F.col("query")))
    return N.normalize_university(c.select("c_custkey", name.alias("name")), "name",
                                  c.select(_title(F.col("entry")).alias("name")))


# ----------------------------------------------------------------- N11
def _chatter(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "event_type", "user_id", "props")
    v = F.col("event_id") % 5
    obj = F.concat(F.lit('{"standardized_program": "  '), F.col("event_type"),
                   F.lit('  ", "standardized_university": "U'), F.col("user_id").cast("string"),
                   F.lit('"}'))
    txt = (F.when(v == 0, F.concat(F.lit("Sure!\nHere it is: "), obj, F.lit(" Thanks {x}")))
           .when(v == 1, obj)
           .when(v == 2, F.lit("I cannot answer that."))
           .when(v == 3, F.concat(F.lit('{"a": {"b": 1}, "standardized_program": "'),
                                  F.col("event_type"), F.lit('"}')))
           .otherwise(F.col("props")))
    return e.select("event_id", txt.alias("answer"))


@register("json_from_chatter", """
WITH e AS (SELECT event_id,
  '{"standardized_program": "  ' || event_type || '  ", "standardized_university": "U'
    || CAST(user_id AS VARCHAR) || '"}' AS obj, event_type, props FROM events),
t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Sure!' || chr(10) || 'Here it is: ' || obj || ' Thanks {x}'
  WHEN 1 THEN obj WHEN 2 THEN 'I cannot answer that.'
  WHEN 3 THEN '{"a": {"b": 1}, "standardized_program": "' || event_type || '"}'
  ELSE props END AS answer FROM e),
c AS (SELECT event_id, CASE WHEN regexp_extract(answer, '(?s)\\{.*?\\}', 0) = '' THEN answer
  ELSE regexp_extract(answer, '(?s)\\{.*?\\}', 0) END AS cand FROM t),
v AS (SELECT event_id, cand, CASE WHEN coalesce(json_valid(cand), false) THEN json_type(cand) = 'OBJECT' ELSE false END AS ok FROM c)
SELECT event_id, ok,
  CASE WHEN ok THEN trim(coalesce(json_extract_string(cand, '$.standardized_program'), '')) END AS program,
  CASE WHEN ok THEN trim(coalesce(json_extract_string(cand, '$.standardized_university'), '')) END AS university
FROM v""")
def q_json_from_chatter(spark, sf):
    t = _chatter(spark, sf)
    return t.select("event_id", json_from_chatter(F.col("answer")).alias("j")).select(
        "event_id", "j.ok", "j.program", "j.university")


# ----------------------------------------------------------------- N12
@register("build_prompts", with_av("""
SELECT p_id, 10 AS n_messages, 'system' AS first_role,
  '{"university": ' || to_json(university) || ', "program": ' || to_json(raw_program) || '}'
    AS last_content
FROM av_rec"""))
def q_build_prompts(spark, sf):
    r = applicant_records(spark, sf).select("p_id", "university", "raw_program")
    m = N.build_prompts(r, "university", "raw_program")
    return m.select("p_id", F.size("messages").alias("n_messages"),
                    F.col("messages")[0]["role"].alias("first_role"),
                    F.element_at("messages", -1)["content"].alias("last_content"))


# ----------------------------------------------------------------- N13
@register("enrich", with_av("""
SELECT p_id, CASE WHEN p_id % 4 = 0 THEN raw_program || ', ' || university ELSE raw_program END AS program,
  CASE WHEN p_id % 4 = 0 THEN NULL ELSE university END AS university, raw_program AS llm_generated_program,
  CASE WHEN university = 'MIT' THEN 'Mit' ELSE university END AS llm_generated_university
FROM av_rec"""))
def q_enrich(spark, sf):
    """Rules path (no model, no dictionary) over every AV record; in every fourth
    the program text holds the university, which the rules split off."""
    r = applicant_records(spark, sf)
    joint = F.col("p_id") % 4 == 0
    r = r.select("p_id", F.when(joint, F.concat_ws(", ", "raw_program", "university")).otherwise(F.col("raw_program")).alias("program"),
                 F.when(~joint, F.col("university")).alias("university"))
    return N.enrich(r, "university", "program")


@register("enrich_model", with_av("""
SELECT p_id, CASE WHEN p_id % 3 = 0 THEN raw_program ELSE 'Model Of ' || raw_program END AS llm_generated_program,
  CASE WHEN p_id % 3 = 0 THEN 'Unknown' WHEN university = 'MIT' THEN 'Mit' ELSE university END AS llm_generated_university
FROM (SELECT *, row_number() OVER () FROM av_rec) r"""))
def q_enrich_model(spark, sf):
    """A deterministic user function as the model; where it answers no JSON
    object the rules split the program text, which holds no university."""
    r = applicant_records(spark, sf)
    r = r.select("p_id", F.concat(F.col("raw_program"), F.when(F.col("p_id") % 3 == 0, F.lit(" ")).otherwise(F.lit(""))).alias("program"),
                 "university")

    def infer(frame):
        import json

        import pandas as pd

        return pd.Series(["I cannot tell." if p.endswith(" ") else
                          "Here: " + json.dumps({"standardized_program": "model of " + p, "standardized_university": u})
                          for u, p in zip(frame["university"], frame["program"])])

    return N.enrich(r, "university", "program", infer).select("p_id", "llm_generated_program", "llm_generated_university")
