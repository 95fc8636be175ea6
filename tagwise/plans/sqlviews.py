"""DuckDB spellings of the fixture views, as CTEs for the oracle SQL.

The oracle is independent of the Spark code: it only sees the raw test tables
(pre-registered as views) and rebuilds ``posts`` and the rest from the same
formulas (FIXTURES.md). ``with_views("scores")`` returns a ``WITH`` clause holding
``scores`` and everything it depends on, in dependency order.
"""

from __future__ import annotations

from .. import vocab
from ..functions.hashing import duck_md5_unit, duck_seeded_bucket
from ..vocab import sql_str


def _word_lit() -> str:
    items = ", ".join(
        "{'label': %s, 'word': %s}" % (sql_str(lbl), sql_str(vocab.FIXTURE_WORDS[lbl]))
        for lbl in vocab.CANONICAL_LABELS)
    return f"[{items}]"


def canon_list() -> str:
    return vocab.sql_str_array(vocab.CANONICAL_LABELS, duck=True)


def _posts(null_every: int | None) -> str:
    hits = (f"list_filter({_word_lit()}, lambda w: "
            f"instr(lower(d.text), ' ' || w.word || ' ') > 0)")
    tech = "list_transform(hits, lambda w: w.label)"
    trig = ("list_transform(hits, lambda w: [instr(lower(text), ' ' || w.word || ' '), "
            "instr(lower(text), ' ' || w.word || ' ') + length(w.word)])")
    manip = f"coalesce(quality = 0 OR toxic = 1, len({tech}) > 0)"
    if null_every:
        isnull = f"doc_id % {null_every} = 0"
        tech = f"CASE WHEN NOT ({isnull}) THEN {tech} END"
        trig = f"CASE WHEN NOT ({isnull}) THEN {trig} END"
        manip = f"coalesce(quality = 0 OR toxic = 1, coalesce(len({tech}) > 0, false))"
    return (
        "SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, lang, "
        f"{manip} AS manipulative, {tech} AS techniques, {trig} AS trigger_words "
        f"FROM (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic, {hits} AS hits "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) _h"
    )


def _q(x: str) -> str:
    return "'''' || " + x + " || ''''"


def numpy_list_text(arr: str) -> str:
    return f"('[' || array_to_string(list_transform({arr}, lambda x: {_q('x')}), ' ') || ']')"


def python_list_text(arr: str) -> str:
    return f"('[' || array_to_string(list_transform({arr}, lambda x: {_q('x')}), ', ') || ']')"


def _label_text() -> str:
    aliased = ("list_transform(techniques, lambda x: upper(CASE x "
               "WHEN 'fud' THEN 'fear_uncertainty_doubt' "
               "WHEN 'bandwagon' THEN 'appeal_to_people' "
               "WHEN 'cliche' THEN 'thought_terminating_cliche' ELSE x END))")
    with_unknown = f"list_concat({aliased}, ['name_calling'])"
    m = "(CAST(id AS BIGINT) % 6)"
    return (
        "SELECT id, content, lang, manipulative, CASE "
        f"WHEN {m} = 0 THEN {numpy_list_text('techniques')} "
        f"WHEN {m} = 1 THEN {python_list_text('techniques')} "
        f"WHEN {m} = 2 THEN array_to_string(techniques, '') "
        f"WHEN {m} = 3 THEN array_to_string(techniques, ', ') "
        f"WHEN {m} = 4 THEN NULL "
        f"ELSE {numpy_list_text(with_unknown)} END AS techniques_text FROM posts"
    )


def _raw_predictions() -> str:
    m = "(CAST(id AS BIGINT) % 7)"
    return (
        "SELECT id, CASE "
        f"WHEN {m} = 0 THEN array_to_string(techniques, ', ') "
        f"WHEN {m} = 1 THEN {numpy_list_text('techniques')} "
        f"WHEN {m} = 2 THEN '' "
        f"WHEN {m} = 3 THEN NULL "
        f"WHEN {m} = 4 THEN 'The text uses ' || array_to_string(techniques, ' and ') || '.' "
        f"WHEN {m} = 5 THEN concat_ws(', ', 'name_calling', array_to_string(techniques, ', ')) "
        f"ELSE {sql_str(vocab.GENERATION_ERROR)} END AS raw_prediction FROM posts"
    )


def _scores() -> str:
    h = duck_md5_unit("p.id || lab.label")
    return (
        "SELECT id, label, y, CAST(0.55 AS DOUBLE) * y + CAST(0.45 AS DOUBLE) * h AS score, "
        "CAST(CAST(0.3 AS DOUBLE) * y + CAST(0.7 AS DOUBLE) * h >= CAST(0.5 AS DOUBLE) AS INTEGER) AS p "
        "FROM (SELECT p.id, lab.label, CAST(list_contains(p.techniques, lab.label) AS INTEGER) AS y, "
        f"{h} AS h FROM posts p CROSS JOIN (SELECT unnest({canon_list()}) AS label) lab) _s"
    )


def _store() -> str:
    return (
        "SELECT p.id, e.embedding, p.techniques, p.manipulative, p.content AS original_text, "
        "p.trigger_words AS trigger_positions FROM posts p "
        "JOIN embeddings e ON p.id = CAST(e.vec_id AS VARCHAR)"
    )


def _submitted() -> str:
    return f"SELECT id, techniques FROM posts WHERE {duck_seeded_bucket('id')} < 70"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "posts": ((), _posts(None)),
    "posts_nulls": ((), _posts(17).replace("FROM (SELECT d.doc_id", "FROM (SELECT d.doc_id", 1)),
    "label_text": (("posts",), _label_text()),
    "raw_predictions": (("posts",), _raw_predictions()),
    "scores": (("posts",), _scores()),
    "store": (("posts",), _store()),
    "submitted": (("posts",), _submitted()),
}


def with_views(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named views (dependencies first) plus ``extra``
    (name, sql) CTEs appended in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
