"""DuckDB twins of the column functions, used by the oracle SQL of each query.

These are text snippets for the *check* (``oracle_sql``), not an engine:
the Spark side never parses them.
"""

from __future__ import annotations

from corpuslab.functions.text import FAILURE_MARKERS, WS_CLASS


def bt(x: str) -> str:
    """blank_trim / as_text: NULL -> '', strip both ends."""
    return f"coalesce(regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g'), '')"


def fold(x: str) -> str:
    markers = ", ".join(f"'{m}'" for m in FAILURE_MARKERS)
    return f"CASE WHEN upper({bt(x)}) IN ({markers}) THEN '' ELSE {bt(x)} END"


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_CLASS}'), lambda t: t <> '')"


def seeded_key(seed: int, *exprs: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(exprs)}))"


def to_number(x: str) -> str:
    s = f"TRY_CAST(regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g') AS DOUBLE)"
    return f"CASE WHEN isnan({s}) THEN NULL ELSE {s} END"
