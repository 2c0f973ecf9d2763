"""Rule tables as array literals, behind a check of their size."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

# Rule tables up to this many rows travel inside the plan. Larger ones are
# joined; both ways give the same result.
MAX_INLINE_RULES = 2000


def fits_inline(rules: DataFrame, max_rows: int = MAX_INLINE_RULES) -> bool:
    """Whether a rule table is small enough to be carried by the plan."""
    return rules.limit(max_rows + 1).count() <= max_rows


def inline_array(rules: DataFrame, *columns: str) -> Column:
    """The rows as ``array<struct<...>>`` literal. Call only after ``fits_inline``."""
    picked = rules.select(*columns)
    rows = [row.asDict(recursive=True) for row in picked.collect()]
    schema = f"array<{picked.schema.simpleString()}>"
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False, default=str)), schema)


def inline_strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), "array<string>")


def inline_nested(rows: list[dict], schema: str) -> Column:
    """Nested rule rows as a literal of the given array type."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False, default=str)), schema)
