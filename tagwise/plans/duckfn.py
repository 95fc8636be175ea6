"""DuckDB spellings of the column functions, for the oracle SQL.

Written independently from the Spark expressions: same rule, SQL dialect. DuckDB's
``regexp_replace`` replaces only the first match unless given the 'g' option.
"""

from __future__ import annotations

from .. import vocab
from ..functions import text as T
from ..vocab import sql_str


def canon(labels: list[str] | None = None) -> str:
    return vocab.sql_str_array(labels or vocab.CANONICAL_LABELS, duck=True)


def rx(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {sql_str(pattern)}, {sql_str(repl)}, 'g')"


def py_strip(expr: str) -> str:
    return rx(expr, r"^\s+|\s+$")


def split_ws(expr: str) -> str:
    return f"list_filter(string_split_regex({py_strip(expr)}, '\\s+'), lambda x: x <> '')"


def bracket_split(c: str) -> str:
    t = rx(rx(c, r"^[\[\]]+|[\[\]]+$"), "'")
    return f"coalesce({split_ws(t)}, [])"


def quoted_or_single(c: str) -> str:
    toks = f"regexp_extract_all({c}, {sql_str(chr(39) + '([^' + chr(39) + ']*)' + chr(39))}, 1)"
    return f"(CASE WHEN {c} IS NULL THEN [] WHEN len({toks}) > 0 THEN {toks} ELSE [{c}] END)"


def canonical(c: str) -> str:
    low = f"lower({py_strip(c)})"
    forms = ", ".join(sql_str(x) for x in ["", "[]", "{}", "()", "nan"])
    return (f"(CASE WHEN {c} IS NULL OR {low} IN ({forms}) THEN [] "
            f"ELSE list_filter({canon(sorted(vocab.CANONICAL_LABELS))}, lambda t: instr({low}, t) > 0) END)")


def quote_delimited(c: str) -> str:
    t = rx(rx(rx(c, r"^[\[\] ]+|[\[\] ]+$"), r"'\s+'", "|"), "'")
    toks = f"list_filter(list_transform(string_split({t}, '|'), lambda x: {py_strip('x')}), lambda x: x <> '')"
    bad = f"({c} IS NULL OR {py_strip(c)} IN ('[]', '', 'nan'))"
    return f"(CASE WHEN {bad} THEN [] ELSE {toks} END)"


def multi_hot_str(arr: str, labels: list[str]) -> str:
    return (f"array_to_string(list_transform({canon(labels)}, "
            f"lambda v: CAST(CAST(list_contains(coalesce({arr}, []), v) AS INTEGER) AS VARCHAR)), ',')")


def alias_case(x: str) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in vocab.LABEL_ALIASES.items())
    return f"(CASE {x} {whens} END)"


def labels_alias(c: str) -> str:
    toks = f"regexp_extract_all({c}, {sql_str(chr(39) + '(.*?)' + chr(39))}, 1)"
    mapped = f"list_transform({toks}, lambda x: {alias_case('lower(' + py_strip('x') + ')')})"
    known = f"list_filter({mapped}, lambda x: x IS NOT NULL AND list_contains({canon()}, x))"
    return f"coalesce(list_sort(list_distinct({known})), [])"


def clean_text(c: str, punct: str = " ") -> str:
    t = f"lower(coalesce({c}, ''))"
    t = rx(t, T.URL_ANY)
    t = rx(t, T.MENTION_OR_HASH)
    t = rx(t, T.NOT_WORD_SPACE_APOS, punct)
    t = rx(t, T.SPACE_RUN, " ")
    return f"trim({t})"


def clean_for_embedding(c: str) -> str:
    t = rx(c, T.EMOJI)
    t = rx(t, T.EMBED_URL)
    t = f"lower({t})"
    t = rx(t, T.SPACE_RUN, " ")
    return f"trim({t})"


def count_chars(c: str, chars: str) -> str:
    return f"(length({c}) - length(translate({c}, {sql_str(chars)}, '')))"
