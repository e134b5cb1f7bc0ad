"""Message logs: one row per message, ordered by ``seq`` within ``thread_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN_PREFIX = "do-not-render-"
ROLES = {"view": "human", "click": "ai", "purchase": "tool", "error": "tool", "signup": "system"}


def _thread(order: str = "seq") -> Window:
    return Window.partitionBy("thread_id").orderBy(order)


def messages_of_events(events: DataFrame) -> DataFrame:
    """A message log derived from an event table: thread_id, seq, id, role, content, tool_name, tool_call_id, is_error, value, ts.

    A click is an AI message with one tool call of its own id, and a purchase or error the result of the latest click
    before it in the thread (null without one).
    """
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("event_type"))
    base = events.select(
        F.col("user_id").alias("thread_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"),
        F.col("event_id").alias("id"),
        role.alias("role"),
        F.col("props").alias("content"),
        F.col("event_type"),
        "value",
        "ts",
    )
    last_click = F.last(F.when(F.col("event_type") == "click", F.col("id")), ignorenulls=True).over(
        _thread().rowsBetween(Window.unboundedPreceding, 0)
    )
    return base.select(
        "thread_id",
        "seq",
        "id",
        "role",
        "content",
        F.when(F.col("role") == "ai", F.concat(F.lit("tool_"), (F.col("id") % 4).cast("string"))).alias("tool_name"),
        F.when(F.col("role").isin("ai", "tool"), last_click).alias("tool_call_id"),
        (F.col("event_type") == "error").alias("is_error"),
        "value",
        "ts",
    )


def messages_of_conversations(turns: DataFrame) -> DataFrame:
    """A message log from a table of turns: user is human, assistant is ai."""
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    return turns.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), role.alias("role"), F.col("text").alias("content"))


def last_message(messages: DataFrame) -> DataFrame:
    """The content of each thread's last message; combined before the shuffle, without a sort."""
    return messages.groupBy("thread_id").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))


def nth_message(messages: DataFrame, n: int) -> DataFrame:
    """Each thread's message at a place: from 0 at the start, from -1 at the end; null in a shorter thread."""
    order = F.col("seq") if n >= 0 else F.col("seq").desc()
    at = n + 1 if n >= 0 else -n
    ranked = messages.withColumn("r", F.row_number().over(Window.partitionBy("thread_id").orderBy(order)))
    return ranked.groupBy("thread_id").agg(F.max(F.when(F.col("r") == at, F.col("content"))).alias("content"))


def of_role(messages: DataFrame, *roles: str) -> DataFrame:
    return messages.where(F.col("role").isin(*roles))


def remove_messages(messages: DataFrame, removed: DataFrame) -> DataFrame:
    """The log without the messages named by (thread_id, id)."""
    return messages.join(removed.select("thread_id", "id").distinct(), ["thread_id", "id"], "left_anti")


def visible(messages: DataFrame, prefix: str = HIDDEN_PREFIX, hide_tools: bool = False) -> DataFrame:
    """Messages whose id doesn't begin with the prefix; a null id is kept."""
    shown = messages.where(F.coalesce(~F.startswith(F.col("id").cast("string"), F.lit(prefix)), F.lit(True)))
    return shown.where("role <> 'tool'") if hide_tools else shown


def threads_without(messages: DataFrame, *roles: str) -> DataFrame:
    """Threads in which no message has one of the roles."""
    return (
        messages.groupBy("thread_id")
        .agg(F.max(F.coalesce(F.col("role").isin(*roles), F.lit(False))).alias("has"), F.count("*").alias("n_messages"))
        .where(~F.col("has"))
        .select("thread_id", "n_messages")
    )


def spoken(messages: DataFrame) -> DataFrame:
    """Messages that have content."""
    return messages.where("content is not null and content <> ''")


def has_args(calls: Column) -> Column:
    """Whether any call (a struct with the map ``args``) has arguments."""
    return F.coalesce(F.exists(calls, lambda c: F.size(c["args"]) > 0), F.lit(False))


def side(role: Column) -> Column:
    """Who a message is shown for: the human, or else the assistant."""
    return F.when(role == "human", "human").otherwise("assistant")


def content_string(blocks: Column) -> Column:
    """The text of content blocks, joined by a space; other kinds of block give nothing."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")


def label_text(role: Column, content: Column, calls: Column) -> Column:
    """``role: content`` (``role:`` without content), and the tool calls as JSON if there are any."""
    text = F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit(" "), content)).otherwise("")
    return F.concat(role, F.lit(":"), text, F.when(F.size(calls) > 0, F.concat(F.lit(" - Tool calls: "), F.to_json(calls))).otherwise(""))


def thread_title(messages: DataFrame) -> DataFrame:
    """The first message's text, or the thread's id where it has none."""
    first = F.min_by("content", "seq")
    return messages.groupBy("thread_id").agg(F.coalesce(F.nullif(first, F.lit("")), F.col("thread_id").cast("string")).alias("title"))


def trace(messages: DataFrame, sep: str = "\n") -> DataFrame:
    """Each thread as one text of ``role: content`` lines in order."""
    line = F.struct("seq", F.concat_ws(": ", "role", "content").alias("line"))
    parts = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    return messages.groupBy("thread_id").agg(F.array_join(parts, sep).alias("trace"), F.count("*").alias("n_messages"))


def append(messages: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` after each thread's own messages, with seq carried on. Columns thread_id, seq, role, content."""
    names = ["thread_id", "seq", "role", "content"]
    both = messages.select(*names, F.lit(0).alias("part")).unionByName(more.select(*names, F.lit(1).alias("part")))
    seq = F.row_number().over(Window.partitionBy("thread_id").orderBy("part", "seq")).cast("long") - 1
    return both.select("thread_id", seq.alias("seq"), "role", "content")


def tool_roundtrips(messages: DataFrame) -> DataFrame:
    """Every tool call with its results; one row with null result for a call without."""
    calls = of_role(messages, "ai").select("thread_id", F.col("id").alias("call_id"), "tool_name", F.col("content").alias("args"))
    results = of_role(messages, "tool").select("thread_id", F.col("tool_call_id").alias("call_id"), F.col("id").alias("result_id"), "is_error")
    return calls.join(results, ["thread_id", "call_id"], "left")


def orphan_calls(messages: DataFrame) -> DataFrame:
    """Tool calls that no message answers."""
    calls = of_role(messages, "ai").select("thread_id", F.col("id").alias("call_id"), "tool_name")
    answered = of_role(messages, "tool").select("thread_id", F.col("tool_call_id").alias("call_id"))
    return calls.join(answered, ["thread_id", "call_id"], "left_anti")


def answers_for_orphans(messages: DataFrame, text: str = "The call was handled.") -> DataFrame:
    """A tool message for each unanswered call, to be put before the next submission."""
    return orphan_calls(messages).select("thread_id", F.col("call_id").alias("tool_call_id"), F.lit("tool").alias("role"), F.lit(text).alias("content"))


def last_tool_call(messages: DataFrame) -> DataFrame:
    """The arguments of each thread's last tool call; null where a thread has none."""
    called = F.when(F.col("tool_name").isNotNull(), F.col("seq"))
    return messages.groupBy("thread_id").agg(F.max_by("content", called).alias("args"), F.max_by("id", called).alias("call_id"))


def model_used(messages: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Which model answered how often: the field ``model_name`` of the response metadata."""
    return messages.groupBy(F.col(metadata)["model_name"].alias("model_name")).agg(F.count("*").alias("n"))


def token_usage(messages: DataFrame, keys: list[str], chars_per_token: int = 4) -> DataFrame:
    """Prompt, completion and total tokens per key; a token is taken as ``chars_per_token`` characters."""
    n = F.ceil(F.length(F.coalesce("content", F.lit(""))) / chars_per_token).cast("long")
    reply = F.col("role") == "ai"
    return messages.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~reply, n)), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(reply, n)), F.lit(0)).alias("completion_tokens"),
        F.sum(n).alias("total_tokens"),
    )


def ui_events_of_messages(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Interface events (message_id, ...) with the message that they belong to."""
    return events.join(messages.withColumnRenamed("id", "message_id"), "message_id")


def is_last(messages: DataFrame) -> DataFrame:
    return messages.withColumn("is_last", F.lead("seq").over(_thread()).isNull())


def well_formed(elements: Column) -> Column:
    """Whether every element has id, type, content and additional_kwargs."""
    return F.forall(elements, lambda e: F.forall(F.array(*map(F.lit, ("id", "type", "content", "additional_kwargs"))), lambda k: F.map_contains_key(e, k)))
