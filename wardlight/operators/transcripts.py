"""Model transcripts: query tags, turn control, prompts, cleaning, sections.

A conversation is cut to ``max_turns`` model turns before anything is gathered,
so the per-conversation arrays below are bounded by that number.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import one_decimal

# fixed values: limits, markers and message texts
MAX_TURNS, MAX_QUERIES = 5, 5
CONTEXT_CHARS = (8192 - 2048) * 3
TAIL_CHARS = int(CONTEXT_CHARS * 0.6)
END_TURN = "<end_of_turn>\n"
USER_TURN = "<start_of_turn>user\n"
MODEL_TURN = "<start_of_turn>model\n"
TRIM_NOTE = "[...context trimmed...]\n"
DUPLICATE_TEXT = "Duplicate query. Continue your analysis."
FINAL_TEXT = (
    "\n\nYou have gathered sufficient evidence. "
    "Now write your complete clinical assessment with all 6 sections: "
    "Alert Level, Clinical Assessment, Differential Considerations, "
    "Recommended Actions, Safety Alerts, Key Points."
)
FORCE_TEXT = (
    "No relevant KB evidence was found for this case. "
    "Using your clinical training knowledge, write the complete "
    "clinical assessment now with all 6 sections: "
    "## Alert Level, ## Clinical Assessment, ## Differential Considerations, "
    "## Recommended Actions, ## Safety Alerts, ## Key Points. "
    "Base your recommendations on standard clinical practice."
)
QUERY_TAG = r"(?is)<KB_QUERY>(.*?)</KB_QUERY>"
ANSWER = "## Clinical Assessment"
ASSESSMENT = r"## (?:Alert Level|Clinical Assessment|Recommended)"
ICONS = [
    (["clinical assessment"], "stethoscope"),
    (["evidence", "consideration"], "database"),
    (["suggested action", "treatment"], "treatment"),
    (["safety alert", "safety"], "shield"),
    (["key point"], "list"),
]


def tags(text: Column) -> Column:
    """Contents of all query tags of a text, trimmed, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(QUERY_TAG), 1), tx.strip)


def tag_rows(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("conv_id", "turn", F.posexplode(tags(F.col("text"))).alias("pos", "query"))


def model_turns(transcripts: DataFrame, max_turns: int) -> DataFrame:
    """The first ``max_turns`` assistant turns of each conversation, numbered from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return (
        transcripts.where(F.col("role") == "assistant")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= max_turns)
        .withColumn("step", F.col("_n") - 1)
        .drop("_n")
    )


def turn_outcomes(transcripts: DataFrame, policy: str = "blocking", max_turns: int = MAX_TURNS,
                  max_queries: int = MAX_QUERIES) -> DataFrame:
    """What each model turn leads to, up to and including the turn that ends the loop.

    One row per turn: conv_id, turn, step, query, outcome (query / final_query /
    duplicate / stop), queries_so_far.  ``blocking`` takes the last tag of a turn
    and carries on after a duplicate; ``streaming`` takes the first tag that was
    not used before and stops when there is none.
    """
    turns = model_turns(transcripts, max_turns).select(
        "conv_id", "turn", "step", tags(F.col("text")).alias("tags"),
        F.contains("text", F.lit(ANSWER)).alias("answered"),
    )
    ordered = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "turn", "tags", "answered"))).alias("_turns")
    )
    step_type = "array<struct<turn:bigint,step:int,query:string,outcome:string,queries_so_far:int>>"
    start = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.lit(False).alias("stopped"),
        F.array().cast(step_type).alias("steps"),
    )

    def advance(state, turn):
        used, tags_ = state["used"], turn["tags"]
        asks = (
            (F.size(tags_) > 0) & ~turn["answered"] & (turn["step"] < max_turns - 1)
            & (F.size(used) < max_queries)
        )
        fresh = F.filter(tags_, lambda t: ~F.array_contains(used, F.lower(t)))
        if policy == "blocking":
            query = F.try_element_at(tags_, F.lit(-1))
            known = F.array_contains(used, F.lower(query))
            other = "duplicate"
        else:
            query = F.try_element_at(fresh, F.lit(1))
            known = query.isNull()
            other = "stop"
        took = asks & ~known
        last = F.size(used) + 1 >= max_queries
        outcome = (
            F.when(took & last, "final_query").when(took, "query").when(asks, other).otherwise("stop")
        )
        now_used = F.when(took, F.concat(used, F.array(F.lower(query)))).otherwise(used)
        step = F.struct(
            turn["turn"].cast("bigint").alias("turn"), turn["step"].cast("int").alias("step"),
            F.when(took | (asks & (F.lit(policy) == "blocking")), query).alias("query"),
            outcome.alias("outcome"), F.size(now_used).alias("queries_so_far"),
        )
        moved = F.struct(
            now_used.alias("used"),
            (outcome == "stop").alias("stopped"),
            F.concat(state["steps"], F.array(step)).alias("steps"),
        )
        return F.when(state["stopped"], state).otherwise(moved)

    folded = ordered.select("conv_id", F.aggregate("_turns", start, advance, lambda s: s["steps"]).alias("_steps"))
    return folded.select("conv_id", F.inline("_steps"))


def evidence_block(source: Column, score: Column, content: Column, query: Column) -> Column:
    found = F.concat(
        F.lit('<KB_RESULT source="'), source, F.lit('" score="'), one_decimal(score), F.lit('">\n'),
        content, F.lit("\n</KB_RESULT>"),
    )
    missing = F.concat(
        F.lit('<KB_RESULT source="none" score="0">\nNo KB evidence found for: '), query, F.lit("\n</KB_RESULT>")
    )
    return F.when(source.isNull(), missing).otherwise(found)


def evidence(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """Evidence text of every turn that ran a query; ``results`` holds the top hit per (conv_id, turn)."""
    asked = outcomes.where(F.col("outcome").isin("query", "final_query"))
    joined = asked.join(results.select("conv_id", "turn", "source", "score", "content"), ["conv_id", "turn"], "left")
    block = evidence_block(F.col("source"), F.col("score"), F.col("content"), F.col("query"))
    return joined.select(
        "conv_id", "turn", "step", "query", "outcome",
        F.coalesce("source", F.lit("none")).alias("source"),
        F.coalesce("score", F.lit(0.0)).alias("score"), block.alias("block"),
    )


def opening_prompt(prompt: Column) -> Column:
    started = F.when(prompt.startswith("<bos>"), prompt).otherwise(F.concat(F.lit("<bos>"), prompt))
    return F.when(F.contains(started, F.lit(MODEL_TURN.strip())), started).otherwise(F.concat(started, F.lit(MODEL_TURN)))


def trim_context(text: Column, limit: int = CONTEXT_CHARS) -> Column:
    """Too long a conversation keeps its head up to the first user marker and its tail."""
    head_chars = F.instr(text, USER_TURN) - 1 + len(USER_TURN)
    cut = F.concat(F.substring(text, F.lit(1), head_chars), F.lit(TRIM_NOTE), F.right(text, F.lit(int(limit * 0.6))))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def next_prompts(transcripts: DataFrame, prompts: DataFrame, outcomes: DataFrame, blocks: DataFrame,
                 policy: str = "blocking", max_turns: int = MAX_TURNS) -> DataFrame:
    """Prompt that follows each continuing turn: conv_id, turn, prompt."""
    said = model_turns(transcripts, max_turns).select("conv_id", "turn", "text")
    going = outcomes.where(F.col("outcome") != "stop")
    reply = (
        F.when(F.col("outcome") == "duplicate", F.lit(DUPLICATE_TEXT))
        .when(F.col("outcome") == "final_query", F.concat(F.col("block"), F.lit(FINAL_TEXT)))
        .otherwise(F.col("block"))
    )
    added = F.concat("text", F.lit(END_TURN), F.lit(USER_TURN), reply, F.lit(END_TURN), F.lit(MODEL_TURN))
    parts = (
        going.join(said, ["conv_id", "turn"])
        .join(blocks.select("conv_id", "turn", "block"), ["conv_id", "turn"], "left")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", added.alias("added")))).alias("_parts"))
        .join(prompts.select("conv_id", opening_prompt(F.col("prompt")).alias("_start")), "conv_id")
    )
    shorten = trim_context if policy == "streaming" else (lambda c: c)
    row = "array<struct<turn:bigint,prompt:string>>"
    begin = F.struct(F.col("_start").alias("text"), F.array().cast(row).alias("rows"))

    def extend(state, part):
        grown = shorten(F.concat(state["text"], part["added"]))
        return F.struct(
            grown.alias("text"),
            F.concat(state["rows"], F.array(F.struct(part["turn"].cast("bigint").alias("turn"), grown.alias("prompt")))).alias("rows"),
        )

    folded = parts.select("conv_id", F.aggregate("_parts", begin, extend, lambda s: s["rows"]).alias("_rows"))
    return folded.select("conv_id", F.inline("_rows"))


def conversation_texts(transcripts: DataFrame, outcomes: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """All model text of the turns that were run: conv_id, raw, turns."""
    said = model_turns(transcripts, max_turns).join(outcomes.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi")
    return said.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "").alias("raw"),
        F.count("*").cast("int").alias("turns"),
    )


def missing_assessment(texts: DataFrame) -> DataFrame:
    """Conversations whose text has no assessment section: the forced follow-up they get."""
    return texts.select(
        "conv_id", (~F.col("raw").rlike(ASSESSMENT)).alias("missing"),
        F.when(
            ~F.col("raw").rlike(ASSESSMENT),
            F.concat(F.lit(END_TURN), F.lit(USER_TURN), F.lit(FORCE_TEXT), F.lit(END_TURN), F.lit(MODEL_TURN)),
        ).alias("follow_up"),
    )


def clean(raw: Column) -> Column:
    """Remove think blocks, query tags and control lines, in this order."""
    for pattern in (
        r"(?i)<think>[\s\S]*?</think>", r"(?i)<KB_QUERY>[\s\S]*?</KB_QUERY>",
        r"(?i)<think>[\s\S]*$", r"(?i)</think>",
        r"(?d)QUERY_ESTIMATE:.*", r"(?U)DECISION:\s*\w+", r"(?d)NEXT_QUERY:.*", r"(?d)CASE_COMPLEXITY:.*",
    ):
        raw = F.regexp_replace(raw, pattern, "")
    return raw


def clean_display(raw: Column) -> Column:
    """The display variant: also ``thinking`` tags, a single control marker, trimmed."""
    for pattern in (
        r"(?i)<think(?:ing)?>[\s\S]*?</think(?:ing)?>", r"(?i)<kb_query>[\s\S]*?</kb_query>",
        r"(?i)<think(?:ing)?>[\s\S]*$", r"(?i)</think(?:ing)?>", r"(?i)DECISION:\s*\w+",
    ):
        raw = F.regexp_replace(raw, pattern, "")
    return tx.strip(raw)


def _first_of_each(items: Column, key) -> Column:
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def distinct_sections(cleaned: Column) -> Column:
    """Sections from ``## `` to ``## ``; of equal titles the first stays; no section: the text."""
    heading = r"(?md)^## .+$"
    parts = F.filter(F.split(cleaned, r"(?md)(?=^## .+$)"), lambda p: p.rlike(r"\A(?d)## .+"))
    title = lambda p: F.lower(tx.strip(F.regexp_extract(p, heading, 0)))
    kept = F.transform(_first_of_each(parts, title), tx.strip)
    return F.when(F.size(parts) > 0, tx.strip(F.array_join(kept, "\n\n"))).otherwise(tx.strip(cleaned))


def think_fallback(raw: Column) -> Column:
    """Last think block, from its first ``## ``."""
    last = F.try_element_at(F.regexp_extract_all(raw, F.lit(r"(?i)<think>([\s\S]*?)</think>"), 1), F.lit(-1))
    at = last.rlike(r"## [\s\S]+")
    return F.when(at, F.regexp_extract(last, r"(## [\s\S]+)", 1)).otherwise(last)


def clean_responses(texts: DataFrame) -> DataFrame:
    """conv_id, response: what a reader sees of a conversation's model text."""
    visible = distinct_sections(clean(F.col("raw")))
    return texts.withColumn("_visible", visible).select(
        "conv_id",
        tx.strip(F.coalesce(F.when(F.col("_visible") == "", think_fallback(F.col("raw"))), F.col("_visible"))).alias("response"),
    )


def icon_of(title: Column) -> Column:
    branch = F
    for words, icon in ICONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(title), F.lit(w))
        branch = branch.when(hit, icon)
    return branch.otherwise("report")


def section_array(raw: Column) -> Column:
    """Display sections as an array of (title, icon, content).

    A heading may continue past blank line ends after ``##``.  Without headings a
    text of more than 20 characters is one section.
    """
    heading = r"(?mU)^##\s+(.+)$"
    cleaned = clean_display(raw)
    titles = F.transform(F.regexp_extract_all(cleaned, F.lit(heading), 1), tx.strip)
    bodies = F.split(cleaned, heading)
    made = F.transform(
        titles,
        lambda t, i: F.struct(
            t.alias("title"), icon_of(t).alias("icon"),
            tx.strip(F.regexp_replace(tx.strip(F.element_at(bodies, i + 2)), r"(?m)^## .+$", "")).alias("content"),
        ),
    )
    first = F.filter(_first_of_each(made, lambda s: F.lower(s["title"])), lambda s: s["content"] != "")
    whole = F.array(F.struct(F.lit("Clinical Insight").alias("title"), F.lit("report").alias("icon"), cleaned.alias("content")))
    none = F.array().cast("array<struct<title:string,icon:string,content:string>>")
    return F.when(F.size(titles) > 0, first).when(F.length(cleaned) > 20, whole).otherwise(none)


def sections(texts: DataFrame) -> DataFrame:
    """conv_id, ord, title, icon, content."""
    rows = texts.select("conv_id", F.posexplode(section_array(F.col("raw"))).alias("ord", "_s"))
    return rows.select("conv_id", "ord", "_s.title", "_s.icon", "_s.content")


def rollup(outcomes: DataFrame, hits: DataFrame) -> DataFrame:
    """Per conversation: turns, queries, best score and source, hits of all turns by score.

    ``hits``: conv_id, turn, rank, score, source, title.  At most five queries of
    a few hits each meet in one conversation.
    """
    counts = outcomes.groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("outcome").isin("query", "final_query")).alias("n_queries"),
    )
    key = F.struct((-F.col("score")).alias("o"), "turn", "rank", "score", "source", "title")
    merged = hits.groupBy("conv_id").agg(F.array_sort(F.collect_list(key)).alias("_h"))
    lists = merged.select(
        "conv_id",
        F.element_at("_h", 1)["score"].alias("top_score"),
        F.element_at("_h", 1)["source"].alias("top_source"),
        F.transform("_h", lambda h: h["title"]).alias("titles"),
    )
    return counts.join(lists, "conv_id", "left")
