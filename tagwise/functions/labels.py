"""Label-column repair and encoding as Column expressions.

Label lists arrive as arrays, as ``['a' 'b']`` text (numpy print), as ``['a', 'b']``
text, glued together, or as free model output. Each parser here is one JVM-side
expression over the column (regex, split, higher-order ``filter``/``transform``),
so a whole table is repaired in a single narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

# --- fixed values: patterns --------------------------------------------------------
QUOTED_NONGREEDY = r"'(.*?)'"
QUOTED_NO_QUOTE = r"'([^']*)'"
EMPTY_FORMS = ["", "[]", "{}", "()", "nan"]


def _lit_array(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _present(arr: Column) -> Column:
    """Drop the null slots of an unrolled per-label array."""
    return F.filter(arr, lambda x: x.isNotNull())


def _empty() -> Column:
    return F.array().cast("array<string>")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: trim whitespace of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _split_ws(c: Column) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty items."""
    return F.filter(F.split(py_strip(c), r"\s+"), lambda x: x != "")


def labels_bracket_split(c: Column) -> Column:
    """L1: strip '[' and ']' at the ends, drop quotes, split on whitespace; null -> []."""
    t = F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", "")
    t = F.regexp_replace(t, "'", "")
    return F.coalesce(_split_ws(t), _empty())


def labels_quoted_or_single(c: Column) -> Column:
    """L2: every ``'...'`` token; when there is none, the whole string; null -> []."""
    toks = F.regexp_extract_all(c, F.lit(QUOTED_NO_QUOTE), 1)
    return (F.when(c.isNull(), _empty())
             .when(F.size(toks) > 0, toks)
             .otherwise(F.array(c)))


def labels_canonical(c: Column, labels: list[str] | None = None) -> Column:
    """L3: lower-case; empty forms -> []; every canonical label occurring as a
    substring (glued labels included); sorted and unique (quirk Q5)."""
    labels = sorted(labels or vocab.CANONICAL_LABELS)
    low = F.lower(py_strip(c))
    found = _present(F.array(*[F.when(F.position(F.lit(t), low) > 0, F.lit(t)) for t in labels]))
    return F.when(c.isNull() | low.isin(EMPTY_FORMS), _empty()).otherwise(found)


def quote_delimited_tokens(c: Column) -> Column:
    """L4 tokens: strip '[', ']' and spaces at the ends, turn ``'<spaces>'`` into a
    delimiter, drop the remaining quotes, split, strip, drop empties."""
    t = F.regexp_replace(c, r"^[\[\] ]+|[\[\] ]+$", "")
    t = F.regexp_replace(t, r"'\s+'", "|")
    t = F.regexp_replace(t, "'", "")
    toks = F.filter(F.transform(F.split(t, r"\|"), lambda x: py_strip(x)), lambda x: x != "")
    bad = c.isNull() | py_strip(c).isin("[]", "", "nan")
    return F.when(bad, _empty()).otherwise(toks)


def multi_hot(labels_col: Column, labels: list[str], as_double: bool = False) -> Column:
    """Fixed-vocabulary multi-hot vector; unknown names are ignored."""
    arr = F.coalesce(labels_col, _empty())
    t = "double" if as_double else "int"
    return F.array(*[F.array_contains(arr, v).cast(t) for v in labels])


def unknown_labels(labels_col: Column, labels: list[str]) -> Column:
    """The names in the list that the vocabulary does not know."""
    return F.array_except(F.coalesce(labels_col, _empty()), _lit_array(labels))


def labels_alias(c: Column, labels: list[str] | None = None) -> Column:
    """Quoted tokens, stripped and lower-cased, mapped through the alias table,
    kept if known; sorted and unique. Non-string -> []."""
    labels = labels or vocab.CANONICAL_LABELS
    amap = F.create_map(*[x for kv in vocab.LABEL_ALIASES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    toks = F.regexp_extract_all(c, F.lit(QUOTED_NONGREEDY), 1)
    mapped = F.transform(toks, lambda x: F.try_element_at(amap, F.lower(py_strip(x))))
    known = F.filter(mapped, lambda x: x.isNotNull() & F.array_contains(_lit_array(labels), x))
    return F.coalesce(F.array_sort(F.array_distinct(known)), _empty())


def labels_from_vector(vec: Column, labels: list[str], threshold: float = 0.5,
                       inclusive: bool = False) -> Column:
    """Labels whose score passes the threshold (``>`` or ``>=``, quirk Q17)."""
    def passes(i: int) -> Column:
        v = F.get(vec, i)
        return v >= threshold if inclusive else v > threshold
    return _present(F.array(*[F.when(passes(i), F.lit(t)) for i, t in enumerate(labels)]))


def sigmoid(arr: Column) -> Column:
    """Element-wise logistic function."""
    return F.transform(arr, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def list_text(arr: Column) -> Column:
    """``[a, b]`` text for CSV output."""
    return F.concat(F.lit("["), F.array_join(arr, ", "), F.lit("]"))


def null_to_empty(arr: Column) -> Column:
    """Null label list -> []."""
    return F.coalesce(arr, _empty())
