"""The other dialect of the plans, for comparing results."""

from __future__ import annotations

import re


def duck(sql: str) -> str:
    """DuckDB's names for the few functions and joins that differ."""
    sql = sql.replace("get_json_object(", "json_extract_string(").replace("LEFT ANTI JOIN", "ANTI JOIN").replace("LEFT SEMI JOIN", "SEMI JOIN")
    sql = re.sub(r"explode\(sequence\(", "unnest(generate_series(", sql)
    sql = re.sub(r"string_agg\((\w+), ','\) WITHIN GROUP \(ORDER BY ([\w, ]+)\)", r"string_agg(\1, ',' ORDER BY \2)", sql)
    sql = re.sub(r"conv\((.*?), 16, 10\)", r"('0x' || \1)", sql)
    return re.sub(r"AS STRING\b", "AS VARCHAR", sql)
