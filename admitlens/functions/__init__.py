"""Column expressions (JVM-side; no Python in the hot path)."""

from admitlens.functions.numbers import clamp_limit, pct, round2, try_double
from admitlens.functions.text import (
    clean_text,
    json_from_chatter,
    lower_of,
    split_program_university,
    title_case,
    ws_trim,
)
from admitlens.functions.dates import parse_date
from admitlens.functions.records import (
    classify_badges,
    combine_names,
    parse_prefixed_number,
    resolve_url,
    split_status_date,
)

__all__ = [
    "clamp_limit", "pct", "round2", "try_double",
    "clean_text", "json_from_chatter", "lower_of", "split_program_university",
    "title_case", "ws_trim", "parse_date", "classify_badges", "combine_names",
    "parse_prefixed_number", "resolve_url", "split_status_date",
]
