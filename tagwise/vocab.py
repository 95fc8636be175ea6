"""Label vocabularies and other values that must stay fixed.

Everything in this module is data, not logic: the label names, the two column
orders the outputs use, the alias table, the label definitions used in prompts,
and the fixture words that derive labels from the test tables.
"""

from __future__ import annotations

# --- fixed values: the ten labels in canonical (sorted) order -------------------
CANONICAL_LABELS = [
    "appeal_to_fear",
    "bandwagon",
    "cherry_picking",
    "cliche",
    "euphoria",
    "fud",
    "glittering_generalities",
    "loaded_language",
    "straw_man",
    "whataboutism",
]

# --- fixed values: submission column order --------------------------------------
SUBMISSION_LABELS = [
    "straw_man",
    "appeal_to_fear",
    "fud",
    "bandwagon",
    "whataboutism",
    "loaded_language",
    "glittering_generalities",
    "euphoria",
    "cherry_picking",
    "cliche",
]

# --- fixed values: alias -> canonical label ---------------------------------------
LABEL_ALIASES = {
    "loaded_language": "loaded_language",
    "glittering_generalities": "glittering_generalities",
    "euphoria": "euphoria",
    "appeal_to_fear": "appeal_to_fear",
    "fud": "fud",
    "fear_uncertainty_doubt": "fud",
    "bandwagon": "bandwagon",
    "appeal_to_people": "bandwagon",
    "thought_terminating_cliche": "cliche",
    "thought_terminating_cliché": "cliche",
    "cliche": "cliche",
    "whataboutism": "whataboutism",
    "cherry_picking": "cherry_picking",
    "straw_man": "straw_man",
}

# --- fixed values: label definitions used in prompts ----------------------------
LABEL_DEFINITIONS = {
    "appeal_to_fear": "The misuse of fear (often based on stereotypes or prejudices) to support a particular proposal.",
    "bandwagon": "An attempt to persuade the audience to join and take action because “others are doing the same thing.”",
    "cherry_picking": "Selective use of data or facts that support a hypothesis while ignoring counterarguments.",
    "cliche": "Commonly used phrases that mitigate cognitive dissonance and block critical thinking (e.g., “Everything is not so clear-cut”).",
    "euphoria": "Using an event that causes euphoria or a feeling of happiness, or a positive event to boost morale, often used to mobilize the population.",
    "fud": "Presenting information in a way that sows uncertainty and doubt, causing fear. A subtype of Appeal to Fear.",
    "glittering_generalities": "Exploitation of people's positive attitude towards abstract concepts such as “justice,” “freedom,” “democracy,” “patriotism,” “peace,” etc., to provoke strong emotional reactions without specific information.",
    "loaded_language": "The use of words and phrases with a strong emotional connotation (positive or negative) to influence the audience.",
    "straw_man": "Distorting the opponent's position by replacing it with a weaker or outwardly similar one and refuting it instead.",
    "whataboutism": "Discrediting the opponent's position by accusing them of hypocrisy without directly refuting their arguments.",
}

# --- fixed values: fixture words that mark a label in the test documents --------
# (label present iff ' ' || word || ' ' occurs in lower(text))
FIXTURE_WORDS = {
    "appeal_to_fear": "auf",
    "bandwagon": "los",
    "cherry_picking": "than",
    "cliche": "des",
    "euphoria": "reed",
    "fud": "par",
    "glittering_generalities": "ered",
    "loaded_language": "with",
    "straw_man": "ouen",
    "whataboutism": "dans",
}

# --- fixed values: special model-output markers ---------------------------------
GENERATION_ERROR = "[GENERATION_ERROR]"
CONTENT_NOT_FOUND = "[CONTENT NOT FOUND IN test_dataset_raw]"

DEFAULT_SEED = 42


def sql_str(s: str) -> str:
    """Quote a Python string as an SQL literal (works in Spark SQL and DuckDB)."""
    return "'" + s.replace("'", "''") + "'"


def sql_str_array(items: list[str], duck: bool = False) -> str:
    body = ", ".join(sql_str(x) for x in items)
    return f"[{body}]" if duck else f"array({body})"
