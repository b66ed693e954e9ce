"""Date parsing with strptime('%b %d, %Y') semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from admitlens.fixed_values import WS_CLASS


def parse_date(c: Column) -> Column:
    """L2: 'Mar 12, 2025' -> DATE. Trimmed, inner blanks flexible, month name
    case-free; anything else ('March', 'Sept', 'Feb 30', '') -> NULL."""
    from admitlens.functions.text import ws_trim

    norm = F.regexp_replace(ws_trim(c), f"{WS_CLASS}+", " ")
    # Title-case the month so that 'mar' / 'MAR' parse like strptime's %b.
    norm = F.concat(F.upper(F.substring(norm, 1, 1)), F.lower(F.substring(norm, 2, 2)),
                    F.substring(norm, 4, 1 << 30))
    return F.when(norm.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
                  F.try_to_date(norm, "MMM d, yyyy"))
