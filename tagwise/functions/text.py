"""Text cleaning as Column expressions (all JVM-side ``regexp_replace`` chains).

Java's ``\\w`` and ``\\s`` are ASCII by default while the reference ran Python's
Unicode classes, so the classes are spelled out: word = ``[\\p{L}\\p{N}_]`` and the
Python whitespace set listed below. The same class strings work in DuckDB's RE2,
which is what lets the oracle use identical patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes and patterns --------------------------------
# Python str.isspace() characters.
PY_SPACE = (r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"
URL_ANY = rf"(http[^{PY_SPACE}]+|www[^{PY_SPACE}]+|https[^{PY_SPACE}]+)"
MENTION_OR_HASH = rf"(@[{WORD}]+|#)"
NOT_WORD_SPACE_APOS = rf"[^{WORD}{PY_SPACE}']"
SPACE_RUN = rf"[{PY_SPACE}]+"
# The same two for Spark: ASCII is told by ranges before any property is looked up, and a single
# blank, which would be replaced by itself, is no match.
_PY_SPACE_WIDE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NOT_KEPT = rf"[\x00-\x08\x0E-\x1B!-&(-/:-@\[-^`{{-\x7F[^\x00-\x7F\p{{L}}\p{{N}}{_PY_SPACE_WIDE}]]"
_SPACES = rf"[{PY_SPACE}]{{2,}}|[\t\n\x{{0B}}\x{{0C}}\r\x{{1C}}-\x{{1F}}{_PY_SPACE_WIDE}]"
# URL rule of the pre-embedding cleaner: scheme then characters of
# [a-zA-Z], [0-9], [$-_@.&+], [!*(),] or %-escapes.
EMBED_URL = r"https?://([a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),]|(%[0-9a-fA-F][0-9a-fA-F]))+"
# Emoji code points (pictographs, symbols, dingbats, flags, joiners, selectors, tags).
EMOJI = (r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{2B00}-\x{2BFF}"
         r"\x{1F1E6}-\x{1F1FF}\x{FE0E}\x{FE0F}\x{200D}\x{20E3}\x{E0020}-\x{E007F}"
         r"\x{3030}\x{303D}\x{3297}\x{3299}\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}"
         r"\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}]")
# Letters that mark Ukrainian vs Russian text.
UK_LETTERS = "їієґ"
RU_LETTERS = "ыэъё"


def _strip_py(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{PY_SPACE}]+|[{PY_SPACE}]+$", "")


def clean_text(c: Column, punct: str = " ") -> Column:
    """P3 (``punct=' '``) / P4 (``punct=''``): lower; drop URLs, mentions and '#';
    replace other non-word, non-space, non-apostrophe characters; collapse
    whitespace; trim. Null becomes ''."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, rf"(?:http|www)[^{PY_SPACE}]+", "")          # https begins with http
    t = F.regexp_replace(t, rf"[@#](?:(?<=@)[{WORD}]+|(?<=#))", "")
    t = F.regexp_replace(t, _NOT_KEPT, punct)
    t = F.regexp_replace(t, _SPACES, " ")
    return F.trim(t)


def clean_for_embedding(c: Column) -> Column:
    """P5: drop emoji, drop URLs, lower, collapse whitespace."""
    t = F.regexp_replace(c, rf"(?![\x00-\xA8]){EMOJI}", "")
    t = F.regexp_replace(t, EMBED_URL, "")
    t = F.lower(t)
    t = F.regexp_replace(t, _SPACES, " ")
    return F.trim(t)


def strip_quotes(c: Column) -> Column:
    """Strip outer double quotes (any number on each side)."""
    return F.regexp_replace(c, r'^"+|"+$', "")


def count_chars(c: Column, chars: str) -> Column:
    """Occurrences of any of ``chars`` in c (length minus length with them removed)."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def language_from_filename(name: Column) -> Column:
    """P9: 'uk' if the file name contains 'uk', else 'ru' if it contains 'ru', else 'uk'."""
    return (F.when(F.instr(name, "uk") > 0, F.lit("uk"))
             .when(F.instr(name, "ru") > 0, F.lit("ru")).otherwise(F.lit("uk")))


def language_from_content(text: Column) -> Column:
    """P10: compare counts of Ukrainian-only and Russian-only letters; on a tie,
    'uk' when 'і' is more frequent than 'ы', else 'ru'."""
    low = F.lower(F.coalesce(text, F.lit("")))
    uk = count_chars(low, UK_LETTERS)
    ru = count_chars(low, RU_LETTERS)
    tie = F.when(count_chars(low, "і") > count_chars(low, "ы"), F.lit("uk")).otherwise(F.lit("ru"))
    return F.when(uk > ru, F.lit("uk")).when(ru > uk, F.lit("ru")).otherwise(tie)


def repaired_language(file_lang: Column, text: Column) -> Column:
    """The file's language unless the content says the other one. Since the
    content rule always answers uk or ru, the content decides (quirk Q9)."""
    cl = language_from_content(text)
    return (F.when((file_lang == "uk") & (cl == "ru"), F.lit("ru"))
             .when((file_lang == "ru") & (cl == "uk"), F.lit("uk"))
             .otherwise(file_lang))
