"""Prompt and training-text rows (T1-T7) built with string expressions.

Every prompt is a ``concat``/``format_string`` over columns; neighbour blocks are
gathered per query with ``collect_list`` (at most k rows per query) and ordered
in-row. JSON lines follow Python's ``json.dumps(..., ensure_ascii=False)`` layout
(``", "`` and ``": "`` separators), with string escaping from ``to_json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab

# --- fixed values: prompt texts and formats --------------------------------------
RETRIEVAL_TEMPLATE = """Analyze the following text for potential manipulation techniques.

Input:
\t•\tQuery text: {query_text}
\t•\tSimilar texts with identified manipulation techniques: {similar_texts_section}

Task:

Based on the similar texts and technique distribution provided:
1. Identify manipulation techniques present in the query text
2. Consider rare techniques that may be underrepresented in similar examples

Reference – Manipulation Techniques:
\t1.\tloaded_language: Use of emotionally charged words to influence the audience. Example: “packing Ukrainians into minibuses” evokes strong negative emotions.
\t2.\tglittering_generalities: Broad, positive-sounding statements that lack specifics. Example: “Ukrainians are a free nation, and we will prevail!” appeals to patriotism without argumentation.
\t3.\teuphoria: Creating an overwhelming sense of success or optimism to boost morale. Example: “We crushed the enemy battalion completely!” emphasizes triumph.
\t4.\tappeal_to_fear: Using fear to push a particular agenda. Example: “Ukrainians abroad may lose banking services!” creates panic.
\t5.\tfud: Sowing fear, uncertainty, or doubt by questioning reality. Example: “Was he really there? Nobody will ever know.” implies deception without evidence.
\t6.\tbandwagon: Encouraging action by claiming that “everyone is doing it.” Example: “More Germans are rejecting sanctions!” suggests a growing movement.
\t7.\tthought_terminating_cliché: Phrases that block critical thinking. Example: “We’ll never know the full truth.” discourages further inquiry.
\t8.\twhataboutism: Deflecting criticism by pointing to another issue instead of addressing concerns. Example: “If their air defense failed, why criticize ours?” shifts focus.
\t9.\tcherry_picking: Selectively presenting facts to fit a narrative. Example: “Mobilization quotas are met in some regions but ignored in others.” lacks context.
\t10.\tstraw_man: Misrepresenting an argument to make it easier to attack. Example: “Teaching gender sensitivity is brainwashing children.” distorts the policy’s intent.

Important:
- Not all techniques in the reference list will appear in your examples or query
- Some techniques may be subtly present despite not appearing in similar examples
- Consider the context and semantic meaning, not just lexical similarity

If no manipulation is detected, return an empty array ([])."""
NEIGHBOUR_BLOCK = "\n%d. Text: %s...\nTechniques: %s\nManipulative: %s\nSimilarity score: %.4f\n"
ANALYZE_POST = "Analyze the following post and list any manipulation techniques used:\n\nPost: "
LABEL_INSTRUCTION = """Identify ALL applicable manipulation techniques used in the following text.
Choose from the list below. If multiple techniques apply, list them separated by commas.

Available Techniques:
{labels_string_with_descriptions}

Text:
{text}

Applicable Manipulation Technique(s):"""
AUGMENT_SYSTEM = ("You are an expert specialized in generating realistic examples of text manipulation techniques, "
                  "specifically within the context of Ukrainian news regarding ot the ongoing war in Ukraine, politic "
                  "and society, mobilization. Your goal is to create training data for Ukrainian language.")
AUGMENT_USER = """Generate exactly {n} diverse and realistic examples of text content that clearly demonstrate the '{t}' manipulation technique.

Definition of '{t}': {d}
Example of '{t}': {e}

Generation Instructions:
1.  Provide exactly {n} distinct examples.
2.  Each example should be around 200 world, like a social media post, news snippet, or quote.
3.  The examples MUST clearly use the '{t}' technique.
4.  Content must be relevant to the Ukrainian context (politics, society, war, international relations). Write in Unrainian reflecting propaganda are acceptable if appropriate for the technique.
5.  Ensure diversity in topic and phrasing across examples.
6.  Do NOT include explanations within the generated text itself.
7.  Format the output STRICTLY as a numbered list, starting immediately (no introductory sentences).

Example Output Format:
1. [Example text 1 using the technique]
2. [Example text 2 using the technique]
...
{n}. [Example text {n} using the technique]

Generate the examples now:
"""
# Chat-template turn markers (defaults of a common open chat format); parameters of chat_render.
CHAT_BOS = "<bos>"
CHAT_START = "<start_of_turn>"
CHAT_END = "<end_of_turn>"
CHAT_ROLE_MAP = {"assistant": "model"}


def labels_with_descriptions(labels: list[str] | None = None) -> str:
    labels = labels or vocab.CANONICAL_LABELS
    return "\n".join(f"- **{x}**: {vocab.LABEL_DEFINITIONS.get(x, 'No description available.')}" for x in labels)


def split_template(template: str, *names: str) -> list[str]:
    """Literal pieces around the placeholders, in order."""
    pieces, rest = [], template
    for n in names:
        a, rest = rest.split("{" + n + "}", 1)
        pieces.append(a)
    pieces.append(rest)
    return pieces


def fill(template: str, **cols: Column) -> Column:
    """template.format(**cols) as a concat of literals and columns (placeholders in
    the order they occur)."""
    order = sorted(cols, key=lambda n: template.index("{" + n + "}"))
    pieces = split_template(template, *order)
    parts: list[Column] = [F.lit(pieces[0])]
    for n, p in zip(order, pieces[1:]):
        parts += [cols[n], F.lit(p)]
    return F.concat(*parts)


def json_str(c: Column) -> Column:
    """A JSON string literal for c (``null`` when c is null)."""
    j = F.to_json(F.struct(c.alias("a")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(j, F.lit(6), F.length(j) - 6))


def messages_json(pairs: list[tuple[str, Column]]) -> Column:
    """``json.dumps([{"role": r, "content": c}, ...])`` layout."""
    parts: list[Column] = [F.lit("[")]
    for i, (role, content) in enumerate(pairs):
        if i:
            parts.append(F.lit(", "))
        parts += [F.lit('{"role": "' + role + '", "content": '), json_str(content), F.lit("}")]
    parts.append(F.lit("]"))
    return F.concat(*parts)


def neighbour_blocks(hits: DataFrame) -> DataFrame:
    """(qid, section): numbered neighbour blocks in rank order. ``hits`` has
    qid, rank, original_text, techniques, manipulative, l2_sq (k rows per qid)."""
    # '%.4f' as Python rounds it: half to even on the exact value
    score = F.bround("l2_sq", 4).cast("decimal(38,4)").cast("string")
    block = F.format_string(NEIGHBOUR_BLOCK.replace("%.4f", "%s"), F.col("rank"), F.substring("original_text", 1, 200),
                            F.array_join(F.coalesce("techniques", F.array().cast("array<string>")), ", "),
                            F.when(F.col("manipulative"), F.lit("True")).otherwise(F.lit("False")), score)
    g = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return g.select("qid", F.array_join(F.transform("bs", lambda x: x["b"]), "").alias("section"))


def retrieval_prompt(queries: DataFrame, sections: DataFrame, template: str = RETRIEVAL_TEMPLATE) -> DataFrame:
    """The template filled with the query text and its neighbour section."""
    j = queries.join(sections, "qid", "left")
    return j.select("qid", fill(template, query_text=F.col("query_text"),
                                similar_texts_section=F.coalesce("section", F.lit(""))).alias("prompt"))


def sft_binary_pairs(posts: DataFrame) -> DataFrame:
    """One JSON line per post: user asks for techniques, assistant answers
    ``true`` for manipulative posts and ``[]`` otherwise (quirk Q11)."""
    answer = F.when(F.col("manipulative"), F.lit("true")).otherwise(F.lit("[]"))
    line = messages_json([("user", F.concat(F.lit(ANALYZE_POST), F.col("content"))), ("assistant", answer)])
    return posts.select("id", line.alias("line"))


def label_user_content(text: Column, labels: list[str] | None = None) -> Column:
    return fill(LABEL_INSTRUCTION.replace("{labels_string_with_descriptions}", labels_with_descriptions(labels)),
                text=text)


def sft_label_pairs(posts: DataFrame, techniques_text: str = "techniques_text") -> DataFrame:
    """Definitions + post -> the raw label string ('' when missing or empty)."""
    t = F.col(techniques_text)
    answer = F.when(t.isNull() | (t == ""), F.lit("")).otherwise(t)
    return posts.select("id", label_user_content(F.col("content")).alias("user"), answer.alias("assistant"))


def chat_render(messages: Column, bos: str = CHAT_BOS, start: str = CHAT_START, end: str = CHAT_END,
                role_map: dict[str, str] | None = None, add_generation_prompt: bool = False) -> Column:
    """T4: messages -> one training string; null when any role/content is null."""
    rm = role_map if role_map is not None else CHAT_ROLE_MAP
    def role(r: Column) -> Column:
        out = r
        for k, v in rm.items():
            out = F.when(r == k, F.lit(v)).otherwise(out)
        return out
    turns = F.transform(messages, lambda m: F.concat(F.lit(start), role(m["role"]), F.lit("\n"), m["content"],
                                                    F.lit(end + "\n")))
    ok = ~F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())
    body = F.concat(F.lit(bos), F.array_join(turns, ""))
    if add_generation_prompt:
        body = F.concat(body, F.lit(start + rm.get("assistant", "assistant") + "\n"))
    return F.when(ok & (F.size(messages) > 0), body)


def conversation_messages(conv: DataFrame) -> DataFrame:
    """Turns of each conversation as one ordered messages array (a chat is one
    training example, so its turns are few)."""
    g = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
                                    .alias("t"))
    return g.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"),
                                                                   x["content"].alias("content"))).alias("messages"))


def inference_prompts(posts: DataFrame) -> DataFrame:
    """Per post the plain instruction prompt and the label-list prompt rendered
    as a chat turn with the generation marker."""
    msg = F.array(F.struct(F.lit("user").alias("role"), label_user_content(F.col("content")).alias("content")))
    return posts.select("id", F.concat(F.lit(ANALYZE_POST), F.col("content")).alias("plain_prompt"),
                        chat_render(msg, add_generation_prompt=True).alias("chat_prompt"))


def augment_prompts(examples: DataFrame, n: int = 25, skip: tuple[str, ...] = ("loaded_language",)) -> DataFrame:
    """T5: per label (all but ``skip``): system + user prompt asking for n examples,
    with the label's definition and an example text. ``examples`` has (label, example)."""
    defs = F.create_map(*[x for kv in vocab.LABEL_DEFINITIONS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    d = F.coalesce(F.try_element_at(defs, F.col("label")), F.lit("A specific manipulation technique."))
    e = F.concat(F.lit('Example: "'), F.col("example"), F.lit('"'))
    tpl = AUGMENT_USER.replace("{n}", str(n))
    user = fill(tpl.replace("{t}", "\u0000"), d=d, e=e)
    user = F.replace(user, F.lit("\u0000"), F.col("label"))
    ex = examples.where(~F.col("label").isin(list(skip)))
    return ex.select("label", F.lit(AUGMENT_SYSTEM).alias("system"), user.alias("user"))
