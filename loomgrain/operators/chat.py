"""Conversations: history windows, sessions, prompts, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrain.functions.text import basename, cut_follow_ups, is_greeting

#: What the assistant is told before anything else; callers pass their own.
BASE_PROMPT = "You answer questions about the given files. Use the context, prefer the pinned context, and say so when it has no answer."
FOLLOW_UP_REQUEST = "\n\nEnd your answer with this block:\nFOLLOW_UP_SUGGESTIONS:\n1. [question]\n2. [question]\n3. [question]\n"


def history_window(messages: DataFrame, turns: int = 20, chars: int = 500, drop_last: bool = False) -> DataFrame:
    """(conv_id, turn, role, content): the last turns before the newest one, for a model.

    Assistant texts end before their follow-up heading; texts are cut to ``chars``
    characters; roles other than assistant count as user.
    """
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    first = 3 if drop_last else 2
    rows = messages.withColumn("back", back).where(F.col("back").between(first, first + turns - 1))
    is_answer = F.lower("role") == "assistant"
    content = F.when(is_answer, cut_follow_ups(F.col("text"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(is_answer, "assistant").otherwise("user").alias("role"), F.substring(content, 1, chars).alias("content"))


def auto_title(text: Column, chars: int = 30) -> Column:
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def titled(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions (id, title, updatedAt); an empty or default title becomes the start of the first user message."""
    first = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "idx").alias("first"))
    bare = F.col("title").isNull() | F.col("title").isin("", "New Chat")
    joined = sessions.join(first, sessions["id"] == first["session_id"], "left")
    return joined.select("id", F.when(bare & F.col("first").isNotNull(), auto_title(F.col("first"))).otherwise(F.col("title")).alias("title"), "updatedAt")


def retained(sessions: DataFrame, most: int = 50) -> DataFrame:
    """The newest sessions; of sessions saved again the latest state counts."""
    latest = sessions.groupBy("id").agg(F.max(F.struct("updatedAt", *[c for c in sessions.columns if c not in ("id", "updatedAt")])).alias("s")).select("id", "s.*")
    return latest.orderBy(F.desc("updatedAt"), "id").limit(most)


def worth_keeping(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with messages or a title of their own."""
    used = messages.select(F.col("session_id").alias("id")).distinct().withColumn("used", F.lit(True))
    return sessions.join(used, "id", "left").where("used OR title <> 'New Chat'").drop("used")


def branched(sessions: DataFrame, messages: DataFrame, session_id, upto: int, new_id) -> tuple[DataFrame, DataFrame]:
    """A new session with the messages up to ``upto`` and ``(Branch)`` after the title."""
    own = sessions.where(F.col("id") == session_id).withColumns({"id": F.lit(new_id), "title": F.concat("title", F.lit(" (Branch)"))})
    return own, messages.where((F.col("session_id") == session_id) & (F.col("idx") <= upto)).withColumn("session_id", F.lit(new_id))


def joined_in_order(df: DataFrame, by: list[str], order: str, text: Column, separator: str) -> DataFrame:
    """(by, text): texts of each group joined in order."""
    rows = df.select(*by, F.struct(F.col(order).alias("o"), text.alias("t")).alias("r")).groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select(*by, F.array_join(F.transform("r", lambda r: r["t"]), separator).alias("text"))


def export_markdown(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, markdown): title and messages under headings, with the names of cited files. The form, its marks and headings are fixed values."""
    who = F.when(F.col("role") == "user", "👤 You").otherwise("🤖 Assistant")
    cited = F.array_join(F.transform("citations", basename), ", ")
    text = F.concat(F.lit("## "), who, F.lit("\n\n"), "content", F.when(F.size("citations") > 0, F.concat(F.lit("\n\n*Sources: "), cited, F.lit("*"))).otherwise(""))
    bodies = joined_in_order(messages, ["session_id"], "idx", text, "\n\n---\n\n")
    return sessions.join(bodies, sessions["id"] == bodies["session_id"]).select("id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "text").alias("markdown"))


def secondary_context(messages: DataFrame, pinned: list[str]) -> DataFrame:
    """(session_id, files): files that the last answer cites and that aren't pinned."""
    last = messages.where("role = 'assistant'").groupBy("session_id").agg(F.max_by("citations", "idx").alias("cited"))
    return last.select("session_id", F.array_except(F.coalesce("cited", F.array().cast("array<string>")), F.array(*map(F.lit, pinned)).cast("array<string>")).alias("files"))


def context_block(hits: DataFrame, text_col: str = "document") -> DataFrame:
    """(context): the hits' texts by rank under numbered marks."""
    text = F.concat(F.lit("--- Context "), F.col("rank").cast("string"), F.lit(" ---\n"), F.col(text_col))
    return joined_in_order(hits.withColumn("_all", F.lit(1)), ["_all"], "rank", text, "\n\n").select(F.col("text").alias("context"))


def pinned_block(files: DataFrame, chars: int = 8000) -> DataFrame:
    """(context): pinned files (position from 1, content) under numbered marks; unreadable ones keep their number."""
    text = F.concat(F.lit("--- Pinned Context "), F.col("position").cast("string"), F.lit(" ---\n"), F.substring("content", 1, chars), F.lit("\n\n"))
    rows = files.where("content IS NOT NULL").withColumn("_all", F.lit(1))
    return joined_in_order(rows, ["_all"], "position", text, "").select(F.col("text").alias("context"))


def system_message(context: Column, pinned: Column | None = None, instruction: Column | None = None, base: str = BASE_PROMPT) -> Column:
    """What a model is told first. Its headings are fixed values, which must be the same for equal results."""
    told = F.concat(F.lit("USER INSTRUCTION:\n"), instruction, F.lit("\n\n\n")) if instruction is not None else F.lit("")
    return F.concat(
        F.lit(f"{base}\n\n"), F.coalesce(told, F.lit("")), F.lit("PINNED CONTEXT:\n"),
        F.coalesce(F.nullif(pinned, F.lit("")), F.lit("None\n")) if pinned is not None else F.lit("None\n"),
        F.lit("\nCONTEXT:\n"), F.coalesce(F.nullif(context, F.lit("")), F.lit("None")),
    )


def model_messages(system: DataFrame, history: DataFrame, question: DataFrame) -> DataFrame:
    """(conv_id, position, role, content) for a model: system messages (conv_id, content), then the turns of ``history``, then the question.

    ``history`` is what ``history_window`` gives; the question (conv_id, content)
    gets the request for follow-ups.
    """
    first = system.select("conv_id", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), "content")
    turns = history.select("conv_id", F.lit(1).alias("_part"), F.col("turn").cast("long"), "role", "content")
    last = question.select("conv_id", F.lit(2).alias("_part"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat("content", F.lit(FOLLOW_UP_REQUEST)).alias("content"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("_part", "turn")) - 1
    return first.unionByName(turns).unionByName(last).select("conv_id", place.alias("position"), "role", "content")


#: Replies to a greeting; callers pass their own.
GREETINGS = ("Hello! What would you like to know about these files?", "Hi! Ask me anything about this workspace.", "Hey! Where shall we start?")


def greeting_reply(question: Column, history_turns: Column, seed: Column, replies: tuple[str, ...] = GREETINGS) -> Column:
    """A reply without search or model where a conversation starts with a greeting, else null; ``seed`` picks which."""
    pick = F.get(F.array(*map(F.lit, replies)), F.pmod(seed, F.lit(len(replies))).cast("int"))
    return F.when(is_greeting(question) & (F.coalesce(history_turns, F.lit(0)) == 0), pick)


def proposed_edits(text: Column) -> Column:
    """Array of (filePath, newContent): the JSON blocks of an answer that have both."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*\n(.*?)```"), 1)
    read = lambda b: F.struct(F.get_json_object(b, "$.filepath").alias("filePath"), F.get_json_object(b, "$.newContent").alias("newContent"))
    return F.filter(F.transform(blocks, read), lambda e: e["filePath"].isNotNull() & e["newContent"].isNotNull())


def git_block(branch: str, files: list[str], diff: str, commits: list[str]) -> str:
    """What a prompt says of a repository's state. The form is a fixed value."""
    rows = [
        "--- Git Context ---", f"Active Branch: {branch}", f"Uncommitted Files: {', '.join(files) or 'None'}",
        f"Diff Summary: {diff or 'No changes'}", f"Recent Commits: {' | '.join(commits) or 'None'}", "-------------------",
    ]
    return "\n".join(rows)
