"""Scalar column functions: cleaning, coercion, labels (JVM-side expressions).

Every function takes and returns a ``Column`` so it stays inside whole-stage
codegen; nothing here calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
# Whitespace = exactly the characters Python's str.isspace() accepts, so
# strip/split agree with the pandas pipelines the corpora come from.
WS_CHARS = r"\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}"
WS_CLASS = f"[{WS_CHARS}]"
# Failure markers a translation API writes instead of an output; compared
# case-insensitively after stripping and folded to ''.
FAILURE_MARKERS = ["ERROR", "NAN", "NONE", "NULL", "<PAD>"]
# Short language codes of the corpus languages, in corpus order.
LANG_SHORT = {"Bhili": "bhb", "Gondi": "gon", "Mundari": "unr", "Santali": "sat"}
# pandas' default NA spellings (read_csv with defaults).
PANDAS_NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN",
                    "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                    "NULL", "NaN", "None", "n/a", "nan", "null"]
# ------------------------------------------------------------------------

# The same set as explicit characters, built by its rule (29 characters).
WS_ALL = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
# The last byte that a text ending in one of them has.
WS_LAST = sorted({c.encode()[-1:] for c in WS_ALL})


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Unicode strip of both ends (NULL stays NULL). ``trim`` with an explicit
    character set makes a table of all characters of a text, so only texts whose
    first character or last byte may be white space are given to it."""
    t = _c(c).cast("string")
    edge = F.substring(t, 1, 1).isin(*WS_ALL) | F.substring(t.cast("binary"), -1, 1).isin(*map(F.lit, WS_LAST))
    return F.when(edge, F.trim(t, F.lit(WS_ALL))).otherwise(t)


def blank_trim(c) -> Column:
    """NULL -> '', then strip both ends."""
    return F.coalesce(ustrip(c), F.lit(""))


def as_text(c) -> Column:
    """NULL -> '', else stripped text (string columns cannot hold NaN)."""
    return blank_trim(c)


def fold_failures(c) -> Column:
    """P5: as_text, then any failure marker (case-insensitive) -> ''."""
    t = as_text(c)
    longest = max(len(m) for m in FAILURE_MARKERS)
    # length first: long texts are never upper-cased just to be compared
    return F.when((F.length(t) <= longest) & F.upper(t).isin(*FAILURE_MARKERS), F.lit("")).otherwise(t)


def na_to_null(c, na_values=PANDAS_NA_VALUES) -> Column:
    """Reader-side NA folding of pandas: exact NA spellings become NULL."""
    return F.when(_c(c).isin(*na_values), F.lit(None).cast("string")).otherwise(_c(c))


def lang_code(c) -> Column:
    """Short code from the fixed table, else first 3 chars lower-cased."""
    m = F.create_map(*[x for k, v in LANG_SHORT.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(c)], F.lower(F.substring(_c(c), 1, 3)))


def ci_label(lo, hi) -> Column:
    """P7: '[lo, hi]' when an interval exists, else ''."""
    return F.when(_c(lo).isNotNull() & _c(hi).isNotNull(),
                  F.concat(F.lit("["), fmt_num(lo), F.lit(", "), fmt_num(hi), F.lit("]"))
                  ).otherwise(F.lit(""))


def fmt_num(c) -> Column:
    """Render a double the way Python's str() does for scores (45.3, 45.0)."""
    return _c(c).cast("double").cast("string")


def to_number(c) -> Column:
    """Text -> double; blank, bad or 'nan' -> NULL."""
    d = ustrip(c).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def split_group(c):
    """P9: 'lang__token' -> (language, token) on the first '__'; NULLs when absent."""
    parts = F.split(_c(c), "__", 2)
    has = _c(c).contains("__")
    return (F.when(has, parts.getItem(0)), F.when(has, parts.getItem(1)))


def ws_tokens(c) -> Column:
    """Whitespace tokens with empties removed (Python str.split()); no
    lambda, so it stays in generated code."""
    return F.array_remove(F.split(_c(c), WS_CLASS + "+"), "")


def word_count(c) -> Column:
    """P10: number of whitespace tokens."""
    return F.size(ws_tokens(as_text(c)))


def safe_pct(x, n, digits: int = 2) -> Column:
    """100 * x / max(n, 1), rounded."""
    return F.round(F.lit(100.0) * _c(x) / F.greatest(_c(n), F.lit(1)), digits)


def safe_rate(x, seconds, digits: int = 2) -> Column:
    """X / max(seconds, 1e-6), rounded."""
    return F.round(_c(x) / F.greatest(_c(seconds).cast("double"), F.lit(1e-6)), digits)


def clip_tokens(c, n: int) -> Column:
    """Keep the first n tokens of a token array (model input limit)."""
    return F.slice(_c(c), 1, n)


def elapsed_minutes(start, end, digits: int = 2) -> Column:
    """Wall time between two timestamps in minutes."""
    return F.round((F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(6e7), digits)
