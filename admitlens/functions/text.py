"""Text expressions with Python string semantics, built from native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from admitlens.fixed_values import (
    CASED_BY_PROPERTY,
    TITLECASE_DIGRAPHS,
    FALLBACK_UNI_EXPANSIONS,
    SPLIT_SEPARATORS,
    WS_CLASS,
)


def _lit(s: str) -> Column:
    return F.lit(s)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda variable).

    Higher-order functions run interpreted, without common-subexpression
    elimination, so an expression referenced several times inside them would
    otherwise be recomputed (and nested CASE chains grow exponentially)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ws_trim(c: Column) -> Column:
    """str.strip(): drop Unicode whitespace at both ends."""
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def clean_text(c: Column) -> Column:
    """NULL -> '', collapse whitespace runs to one blank, trim, then strip
    commas at both ends (only commas: blanks inside them survive)."""
    collapsed = F.regexp_replace(F.coalesce(c, _lit("")), f"{WS_CLASS}+", " ")
    return F.regexp_replace(F.trim(collapsed), "^,+|,+$", "")


def title_case(c: Column) -> Column:
    """Python ``str.title``: a run of cased letters gets its first letter
    upper-cased and the rest lower-cased; every other character is kept."""
    pieces = F.regexp_extract_all(
        c, _lit(f"([{CASED_BY_PROPERTY}]+|[^{CASED_BY_PROPERTY}]+)"), 1)
    digraphs = F.create_map(*[F.lit(c) for kv in TITLECASE_DIGRAPHS.items() for c in kv])

    def word(x: Column) -> Column:
        # Upper-casing may expand a letter (ß -> SS, ﬁ -> FI); its title form
        # keeps only the first letter upper (Ss, Fi). Digraphs have a title
        # form of their own.
        first = F.substring(x, 1, 1)
        up = F.upper(first)
        head = F.coalesce(F.try_element_at(digraphs, first),
                          F.concat(F.substring(up, 1, 1), F.lower(F.substring(up, F.lit(2), F.length(up)))))
        return F.concat(head, F.lower(F.substring(x, F.lit(2), F.length(x))))

    fixed = F.transform(
        pieces, lambda x: F.when(x.rlike(f"^[{CASED_BY_PROPERTY}]"), word(x)).otherwise(x))
    return F.array_join(fixed, "")


def lower_of(c: Column) -> Column:
    """The whole word ``Of`` becomes ``of``."""
    return F.regexp_replace(c, r"\bOf\b", "of")


def split_program_university(c: Column) -> Column:
    """Rule-based split of "program, university" text.

    Returns struct(program, university): program title-cased ('' if absent),
    university expanded / title-cased with ``of`` kept lower, 'Unknown' if absent.
    """
    parts = F.filter(F.transform(F.split(clean_text(c), SPLIT_SEPARATORS), lambda p: F.trim(p)),
                     lambda p: p != "")

    def finish(ps: Column) -> Column:
        prog = F.coalesce(F.try_element_at(ps, F.lit(1)), _lit(""))
        uni = F.coalesce(F.try_element_at(ps, F.lit(2)), _lit(""))

        def expand(u: Column) -> Column:
            # The expansions are applied in turn; an expanded name never
            # matches a later pattern, so one first-match CASE is the same.
            out = None
            for pattern, full in FALLBACK_UNI_EXPANSIONS:
                core = pattern.replace("(?i)", "")
                cond = u.rlike(f"(?i)^(?:{core})\\z")
                out = F.when(cond, _lit(full)) if out is None else out.when(cond, _lit(full))
            e = out.otherwise(u)
            return F.when(u != "", lower_of(title_case(e))).otherwise(_lit("Unknown"))

        return F.struct(title_case(prog).alias("program"), let(uni, expand).alias("university"))

    return let(parts, finish)


def _one_value(c: Column) -> Column:
    """Whether JSON text has one value, an object or array, and nothing behind it: the
    brackets outside strings close at the end and not before."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("early"))

    def closed(bare: Column) -> Column:
        brackets = F.regexp_extract_all(bare, F.lit(r"([{}\[\]])"), 1)
        return bare.rlike(r"(?s)^\s*[{\[].*[}\]]\s*$") & F.aggregate(brackets, start, lambda s, b: F.struct(
            (s["depth"] + F.when(b.isin("{", "["), 1).otherwise(-1)).alias("depth"), (s["n"] + 1).alias("n"),
            (s["early"] | ((s["n"] > 0) & (s["depth"] == 0))).alias("early")), lambda s: ~s["early"] & (s["depth"] == 0))

    return let(F.regexp_replace(c, r'(?s)"(?:[^"\\]|\\.)*"', ""), closed)


CORRUPT = "_corrupt"


def json_object(c: Column, fields: str) -> Column:
    """Text read as one JSON object by a typed, permissive parse, as Python reads it: of
    equal keys the last counts, NaN and infinities are numbers, nothing may follow the
    object. ``fields`` as in a schema; a string field of any other type is its JSON
    text. The struct's ``_corrupt`` is NULL for a good object, else the text."""
    schema = f"{fields}, {CORRUPT} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}
    # Blank text gives no struct at all; as an open brace it gives one of NULLs.
    typed = F.from_json(F.when(c.rlike(r"^\s*\{"), c).otherwise("{"), schema, options)

    def checked(v: Column) -> Column:
        good = v[CORRUPT].isNull() & _one_value(c)      # the parser does not look behind an object
        return v.withField(CORRUPT, F.when(~F.coalesce(good, F.lit(False)), F.coalesce(c, F.lit(""))))

    return let(typed, checked)      # parsed once, not once for each field taken


def json_from_chatter(c: Column) -> Column:
    """The first non-greedy ``{...}`` in free text (or the whole text if
    there is none) read as a JSON object; struct(ok, program, university).

    ``ok`` is false when the text is not JSON or not an object; callers fall back
    to the rule-based split then. Equal keys and NaN are read as Python does.
    """
    found = F.regexp_extract(c, r"(?s)\{.*?\}", 0)
    candidate = F.when(found == "", c).otherwise(found)

    def read(v: Column) -> Column:
        ok = v[CORRUPT].isNull()

        def field(name: str) -> Column:
            return F.when(ok, ws_trim(F.coalesce(v[name], _lit(""))))

        return F.struct(ok.alias("ok"), field("standardized_program").alias("program"), field("standardized_university").alias("university"))

    return let(json_object(candidate, "standardized_program string, standardized_university string"), read)
