"""Record-field expressions used by extraction and loading."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from admitlens.fixed_values import CITIZENSHIP_VALUES, SEMESTER_PATTERN
from admitlens.functions.numbers import try_double
from admitlens.functions.text import let, ws_trim


def split_status_date(c: Column) -> Column:
    """E5: split at the first ' on ' into struct(status, status_date), both
    trimmed; without ' on ' the whole text is the status and the date is NULL."""
    pos = F.locate(" on ", c)
    status = F.when(pos > 0, ws_trim(F.substring(c, F.lit(1), pos - 1))).otherwise(c)
    date = F.when(pos > 0, ws_trim(F.substring(c, pos + 4, F.lit(1 << 30))))
    return F.struct(status.alias("status"), date.alias("status_date"))


def parse_prefixed_number(c: Column, prefix: str) -> Column:
    """Drop every occurrence of ``prefix``, trim, read as double (NULL if
    not a number). The prefix 'GRE' alone means: the first 3-digit run."""
    if prefix == "GRE":
        digits = F.regexp_extract(c, r"\d{3}", 0)
        return F.when(digits != "", digits.cast("double"))
    return try_double(ws_trim(F.replace(c, F.lit(prefix), F.lit(""))))


def _badge_kind(x: Column) -> Column:
    return (
        F.when(x.rlike(SEMESTER_PATTERN), "semester")
        .when(x.isin(*CITIZENSHIP_VALUES), "citizenship")
        .when(x.startswith("GRE V"), "gre_v")
        .when(x.startswith("GRE AW"), "gre_aw")
        .when(x.startswith("GRE"), "gre")
        .when(x.startswith("GPA"), "gpa")
    )


def classify_badges(badges: Column) -> Column:
    """First-match cascade per badge; a later badge of a kind overwrites an
    earlier one. struct(semester, citizenship, gpa, gre, gre_v, gre_aw).

    Pure array functions: no explode, no regrouping, no shuffle. Each badge
    is classified once; the kinds are then picked from that array."""
    kinded = F.transform(badges, lambda x: F.struct(_badge_kind(x).alias("k"), x.alias("v")))

    def build(kb: Column) -> Column:
        def last_of(kind: str) -> Column:
            picked = F.filter(kb, lambda e: F.coalesce(e["k"] == kind, F.lit(False)))
            return F.try_element_at(picked, F.lit(-1))["v"]

        return F.struct(
            last_of("semester").alias("semester"),
            last_of("citizenship").alias("citizenship"),
            parse_prefixed_number(last_of("gpa"), "GPA").alias("gpa"),
            parse_prefixed_number(last_of("gre"), "GRE").alias("gre"),
            parse_prefixed_number(last_of("gre_v"), "GRE V").alias("gre_v"),
            parse_prefixed_number(last_of("gre_aw"), "GRE AW").alias("gre_aw"),
        )

    return let(kinded, build)


def badge_issue_count(badges: Column) -> Column:
    """Numeric badges (GPA / GRE kinds) whose number cannot be read."""
    def bad(x: Column) -> Column:
        # The kind is bound once: inside a lambda every mention would be worked out again.
        return let(_badge_kind(x), lambda k: (
            F.when(k == "gpa", parse_prefixed_number(x, "GPA").isNull())
            .when(k == "gre", parse_prefixed_number(x, "GRE").isNull())
            .when(k == "gre_v", parse_prefixed_number(x, "GRE V").isNull())
            .when(k == "gre_aw", parse_prefixed_number(x, "GRE AW").isNull())))
    return F.size(F.filter(badges, lambda x: F.coalesce(bad(x), F.lit(False))))


def combine_names(university: Column, program: Column) -> Column:
    """L3: "u - p" when both are present, else whichever is present, else NULL
    (an empty string counts as missing)."""
    u = F.nullif(university, F.lit(""))
    p = F.nullif(program, F.lit(""))
    return F.when(u.isNotNull() & p.isNotNull(), F.concat_ws(" - ", u, p)).otherwise(
        F.coalesce(u, p))


@F.pandas_udf(T.StringType())
def _urljoin_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def join(b, h):
        try:
            return None if h is None else urljoin(b or "", h)
        except ValueError:      # a link that is none: NULL, never a failed job
            return None

    return pd.Series([join(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_url(base: Column, href: Column) -> Column:
    """RFC 3986 join of a link against a base URL; no link -> NULL.

    The common forms (absolute URL, host-relative path without dot segments)
    are resolved natively; only the rest goes through an Arrow-batched UDF."""
    root = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"),
                    F.try_parse_url(base, F.lit("AUTHORITY")))
    dotted = href.rlike(r"(^|/)\.\.?(/|$|\?|#)")
    plain = ~dotted & href.rlike(r"^[!$%&'()*+,\-./0-9:=@A-Z_a-z~]*$")
    absolute = href.rlike(r"^https?://[^/]+/") & plain
    rooted = href.rlike(r"^/([^/]|$)") & plain & root.isNotNull()
    native = F.when(absolute, href).when(rooted, F.concat(root, href))
    # The UDF is evaluated for every row by Spark, so hand it NULLs for the
    # rows already resolved natively: it then returns at once.
    hard = href.isNotNull() & native.isNull()
    return F.coalesce(native, _urljoin_udf(F.when(hard, base), F.when(hard, href)))
