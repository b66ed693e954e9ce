"""Standardising program / university names.

Rules run as native column expressions; dictionary steps are joins over the
*distinct* names (broadcast after a size check); the model step (optional,
user supplied) runs in ``mapInPandas`` over distinct (university, program)
pairs only, and results are joined back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.fixed_values import (
    ABBREV_UNI,
    COMMON_PROG_FIXES,
    COMMON_UNI_FIXES,
    FEW_SHOTS,
    PROGRAM_CUTOFF,
    SYSTEM_PROMPT,
    UNIVERSITY_CUTOFF,
)
from admitlens.functions.text import (
    json_from_chatter,
    let,
    lower_of,
    split_program_university,
    title_case,
    ws_trim,
)
from admitlens.operators.fuzzy import fuzzy_match
from admitlens.session import maybe_broadcast, shuffled, store

RULES_PER_CASE = 200


# ------------------------------------------------------------------ N3
def expand_abbreviation(c: Column, rules: list[tuple[str, str]] = ABBREV_UNI) -> Column:
    """Ordered full-match regex table, first hit wins, else unchanged.
    Each list compiles into a CASE expression; long ones into a chain of them,
    since generated code is bounded in size."""
    if not rules:
        return c

    def chain(x: Column) -> Column:
        parts = []
        for a in range(0, len(rules), RULES_PER_CASE):
            out = None
            for pattern, replacement in rules[a:a + RULES_PER_CASE]:
                cond = x.rlike(f"^(?:{pattern})\\z")
                out = F.when(cond, F.lit(replacement)) if out is None else out.when(cond, F.lit(replacement))
            parts.append(out)
        return F.coalesce(*parts, x)

    return let(c, chain)


# ------------------------------------------------------------------ N4
def apply_fixes(c: Column, fixes: dict[str, str]) -> Column:
    """Exact, case-sensitive replacement from a small literal map."""
    if not fixes:
        return c
    m = F.create_map(*[F.lit(x) for kv in fixes.items() for x in kv])
    return let(c, lambda x: F.coalesce(F.try_element_at(m, x), x))


def apply_fixes_table(df: DataFrame, col: str, fixes: DataFrame,
                      src: str = "src", dst: str = "dst") -> DataFrame:
    """N4 with a fixes table: left join (broadcast after a size check)."""
    f = fixes.select(F.col(src).alias("_fx_src"), F.col(dst).alias("_fx_dst")) \
        .dropDuplicates(["_fx_src"])
    j = df.join(maybe_broadcast(f), F.col(col) == F.col("_fx_src"), "left")
    return j.withColumn(col, F.coalesce(F.col("_fx_dst"), F.col(col))).drop("_fx_src", "_fx_dst")


# ------------------------------------------------------------------ N7
def canonical_lookup(df: DataFrame, col: str, dictionary: DataFrame, dict_col: str = "name",
                     out_col: str = "is_canonical") -> DataFrame:
    """Flag values that are exactly a dictionary entry."""
    d = dictionary.select(F.col(dict_col).alias("_canon")).distinct()
    j = df.join(maybe_broadcast(d), F.col(col) == F.col("_canon"), "left")
    return j.withColumn(out_col, F.col("_canon").isNotNull()).drop("_canon")


# ------------------------------------------------------------------ N9 / N10
def _program_pre(c: Column) -> Column:
    p = ws_trim(F.coalesce(c, F.lit("")))
    return title_case(apply_fixes(p, COMMON_PROG_FIXES))


def _university_pre(c: Column) -> Column:
    u = apply_fixes(expand_abbreviation(ws_trim(F.coalesce(c, F.lit("")))), COMMON_UNI_FIXES)
    return let(u, lambda x: F.when(x != "", lower_of(title_case(x))).otherwise(x))


def _dictionary_step(df: DataFrame, pre_col: str, out_col: str, dictionary: DataFrame | None,
                     cutoff: float, empty_value: str | None) -> DataFrame:
    """Exact hit -> keep; else best fuzzy match ≥ cutoff; else keep; then the
    empty-name fallback. Works on distinct names and joins back."""
    if dictionary is None:
        res = F.col(pre_col)
        if empty_value is not None:
            res = F.when(res == "", F.lit(empty_value)).otherwise(res)
        return df.withColumn(out_col, res).drop(pre_col)
    # Stored: the rules run once for this, not for each of the later uses.
    names = store(df.select(pre_col).distinct(), "names")
    flagged = store(canonical_lookup(names, pre_col, dictionary, out_col="_hit"), "flagged")
    misses = flagged.filter(~F.col("_hit"))
    fm = fuzzy_match(misses, pre_col, dictionary, cutoff, out_col="_fz").drop("score")
    mapping = flagged.join(shuffled(fm), pre_col, "left").select(
        pre_col, F.when(F.col("_hit"), F.col(pre_col)).otherwise(
            F.coalesce(F.col("_fz"), F.col(pre_col))).alias("_norm"))
    res = F.col("_norm")
    if empty_value is not None:
        res = F.when(res == "", F.lit(empty_value)).otherwise(res)
    out = df.join(shuffled(mapping), pre_col, "left")
    return out.withColumn(out_col, res).drop(pre_col, "_norm")


def normalize_program(df: DataFrame, col: str, dictionary: DataFrame | None = None,
                      out_col: str | None = None, cutoff: float = PROGRAM_CUTOFF) -> DataFrame:
    """Trim -> fixes -> title case -> exact / fuzzy(0.84) dictionary -> keep."""
    pre = "_prog_pre"
    return _dictionary_step(df.withColumn(pre, _program_pre(F.col(col))), pre, out_col or col,
                            dictionary, cutoff, None)


def normalize_university(df: DataFrame, col: str, dictionary: DataFrame | None = None,
                         out_col: str | None = None,
                         cutoff: float = UNIVERSITY_CUTOFF) -> DataFrame:
    """Trim -> abbreviations -> fixes -> title case (``of`` kept lower)
    -> exact / fuzzy(0.86) dictionary -> keep -> 'Unknown' when empty."""
    pre = "_uni_pre"
    return _dictionary_step(df.withColumn(pre, _university_pre(F.col(col))), pre, out_col or col,
                            dictionary, cutoff, "Unknown")


# ------------------------------------------------------------------ N12
def _json_string(c: Column) -> Column:
    """A JSON string literal of ``c`` (escaped like json.dumps, non-ASCII kept)."""
    arr = F.to_json(F.array(c))
    return F.substring(arr, F.lit(2), F.length(arr) - 2)


def user_content(university: Column, program: Column) -> Column:
    """json.dumps({"university": u, "program": p}) with its default separators."""
    return F.concat(F.lit('{"university": '), _json_string(university),
                    F.lit(', "program": '), _json_string(program), F.lit("}"))


def build_prompts(df: DataFrame, university_col: str, program_col: str,
                  system: str = SYSTEM_PROMPT, shots=FEW_SHOTS,
                  out_col: str = "messages") -> DataFrame:
    """Per row the ordered chat messages: system text, few-shot pairs,
    then the row's own (university, program) as JSON."""
    fixed = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))]
    for x_in, x_out in shots:
        fixed.append(F.struct(F.lit("user").alias("role"),
                              F.lit(json.dumps(x_in, ensure_ascii=False)).alias("content")))
        fixed.append(F.struct(F.lit("assistant").alias("role"),
                              F.lit(json.dumps(x_out, ensure_ascii=False)).alias("content")))
    u = F.coalesce(F.col(university_col), F.lit(""))
    p = F.coalesce(F.col(program_col), F.lit(""))
    last = F.struct(F.lit("user").alias("role"), user_content(u, p).alias("content"))
    return df.withColumn(out_col, F.array(*fixed, last))


# ------------------------------------------------------------------ N13
InferFn = Callable[[pd.DataFrame], pd.Series]


def enrich(df: DataFrame, university_col: str = "university", program_col: str = "program",
           infer_fn: InferFn | None = None, program_dict: DataFrame | None = None,
           university_dict: DataFrame | None = None) -> DataFrame:
    """Add ``llm_generated_program`` / ``llm_generated_university``;
    every other column is untouched.

    Per distinct (university, program) pair: the model's answer (``infer_fn``:
    pandas DataFrame with columns university, program, messages -> Series of
    answer texts, run in mapInPandas), read by N11 when it holds a JSON object,
    else the rule split N2 of the program text. Without a model the pair itself,
    or the rule split where there is no university. Then N9 / N10."""
    u_key, p_key = "_en_u", "_en_p"
    keyed = df.withColumn(u_key, F.coalesce(F.col(university_col).cast("string"), F.lit(""))) \
        .withColumn(p_key, F.coalesce(F.col(program_col).cast("string"), F.lit("")))
    pairs = keyed.select(u_key, p_key).distinct()
    if infer_fn is None:
        # No model: the pair itself, or the rule split where there is no university.
        split = split_program_university(F.col(p_key))
        no_uni = F.trim(F.col(u_key)) == ""
        parsed = pairs.withColumn("_fb", split).select(
            u_key, p_key, F.when(no_uni, F.col("_fb.program")).otherwise(F.col(p_key)).alias("_sp"),
            F.when(no_uni, F.col("_fb.university")).otherwise(F.col(u_key)).alias("_su"))
    else:
        prompts = build_prompts(pairs, u_key, p_key)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                view = pd.DataFrame({"university": pdf[u_key], "program": pdf[p_key],
                                     "messages": pdf["messages"]})
                out = pdf[[u_key, p_key]].copy()
                out["_answer"] = list(infer_fn(view))
                yield out

        answered = prompts.mapInPandas(run, f"{u_key} string, {p_key} string, _answer string")
        read = answered.withColumn("_js", json_from_chatter(F.col("_answer"))) \
            .withColumn("_fb", split_program_university(F.col(p_key)))
        ok = F.col("_js.ok")
        parsed = read.select(
            u_key, p_key, F.when(ok, F.col("_js.program")).otherwise(F.col("_fb.program")).alias("_sp"),
            F.when(ok, F.col("_js.university")).otherwise(F.col("_fb.university")).alias("_su"))
    std = parsed
    std = normalize_program(std, "_sp", program_dict, out_col="llm_generated_program")
    std = normalize_university(std, "_su", university_dict, out_col="llm_generated_university")
    std = std.drop("_sp", "_su")
    base = keyed.drop("llm_generated_program", "llm_generated_university")
    return base.join(std, [u_key, p_key], "left").drop(u_key, p_key)
