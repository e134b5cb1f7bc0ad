"""Which model, tools and prompt a call gets, by thread length, role, state or language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .trace import last_message

LONG_THREAD = 10
#: Fixed value: steps that an agent may take.
STEP_LIMIT = 40
#: Tools by role; roles that aren't listed have the tools of ``None``.
ROLE_TOOLS: dict[str | None, list[str]] = {
    "internal": ["web_search", "sql_query"],
    "admin": ["web_search", "sql_query", "delete_rows"],
    "analyst": ["web_search", "sql_query"],
    "support": ["web_search", "read_tickets"],
    None: ["web_search"],
}
DEFAULT_ROLE = "external"


def route_model(n_messages: Column, large: str = "large", standard: str = "standard") -> Column:
    """The large model from the eleventh message on."""
    return F.when(n_messages > LONG_THREAD, large).otherwise(standard)


def gate_by_role(requests: DataFrame, role: str = "role", rules: dict[str | None, list[str]] = ROLE_TOOLS) -> DataFrame:
    """One row per request and tool that its role may use; a missing role is DEFAULT_ROLE."""
    r = F.coalesce(F.col(role), F.lit(DEFAULT_ROLE))
    tools = F.array(*map(F.lit, rules[None]))
    for name, allowed in rules.items():
        if name is not None:
            tools = F.when(r == name, F.array(*map(F.lit, allowed))).otherwise(tools)
    return requests.withColumn("tool", F.explode(tools))


def gate_by_login(authenticated: Column) -> Column:
    """Tools before and after logging in; an unknown state counts as logged out."""
    inside = F.array(F.lit("check_inbox"), F.lit("send_email"))
    return F.when(F.coalesce(authenticated, F.lit(False)), inside).otherwise(F.array(F.lit("authenticate")))


def same_credentials(given_name: Column, given_word: Column, name: Column, word: Column) -> Column:
    return given_name.eqNullSafe(name) & given_word.eqNullSafe(word)


def prompt_for(base: str, language: Column, default: str = "English") -> Column:
    """The base prompt, and the language to answer in unless it is the default."""
    lang = F.coalesce(language, F.lit(default))
    return F.when(lang == default, F.lit(base)).otherwise(F.concat(F.lit(f"{base} only respond in "), lang, F.lit(".")))


def with_context(df: DataFrame, defaults: dict[str, str], given: DataFrame | None = None, key: str = "request_id") -> DataFrame:
    """``df`` with context fields: a request's own value, or the default."""
    if given is not None:
        df = df.join(given, key, "left")
    have = set(df.columns)
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in defaults.items()})


Transform = Callable[[DataFrame], DataFrame]


def stacked(df: DataFrame, steps: list[Transform]) -> DataFrame:
    """Transforms applied in the order of the list."""
    return reduce(lambda d, step: step(d), steps, df)


@dataclass
class Middleware:
    """Hooks around a model call: before it, around it (gets the call and the rows), after it."""

    before: Transform | None = None
    wrap: Callable[[Transform, DataFrame], DataFrame] | None = None
    after: Transform | None = None


def run_agent(df: DataFrame, model: Transform, stack: list[Middleware]) -> DataFrame:
    """Before-hooks in the order of the list, the model inside its wraps (the first is the outermost), after-hooks in reverse."""
    call = model
    for m in reversed(stack):
        if m.wrap:
            call = partial(m.wrap, call)
    before = [m.before for m in stack if m.before]
    after = [m.after for m in reversed(stack) if m.after]
    return stacked(call(stacked(df, before)), after)


def model_config(df: DataFrame, model: Column, temperature: Column | None = None, max_tokens: Column | None = None) -> DataFrame:
    """``df`` with the parameters of its call: model, temperature (1 unless given), max_tokens (null: no bound)."""
    return df.withColumns(
        {
            "model": model,
            "temperature": F.coalesce(temperature if temperature is not None else F.lit(None), F.lit(1.0)).cast("double"),
            "max_tokens": (max_tokens if max_tokens is not None else F.lit(None)).cast("int"),
        }
    )


def stub_reply(model: Column, prompt: Column, max_tokens: Column) -> Column:
    """Stands in for a model's answer: its name and the prompt, cut to four characters a token; nothing is generated."""
    text = F.concat(model, F.lit(" heard: "), F.coalesce(prompt, F.lit("")))
    return F.when(max_tokens.isNotNull(), F.left(text, 4 * max_tokens)).otherwise(text)


def delegate(requests: DataFrame, agent: Transform) -> DataFrame:
    """What a coordinator gets of a sub-agent: the last message of each request's own thread; what came before stays inside.

    ``requests``: request_id, content. ``agent`` takes a log with one human message a thread and returns the whole log.
    """
    log = requests.select(F.col("request_id").alias("thread_id"), F.lit(0).cast("long").alias("seq"), F.lit("human").alias("role"), "content")
    return last_message(agent(log)).select(F.col("thread_id").alias("request_id"), "content")


class StepLimit(RuntimeError):
    """An agent took more steps than it may."""


def run_steps(state: DataFrame, step: Transform, is_open: Column, limit: int = STEP_LIMIT) -> DataFrame:
    """``step`` again and again on the rows that are open, until none is; StepLimit after ``limit`` steps.

    Each step's rows are written to the shared folder, so that a step is computed once.
    """
    for n in range(limit + 1):
        state = checkpointed(state)
        going = state.where(is_open)
        if going.isEmpty():
            return state
        if n < limit:
            state = state.where(~F.coalesce(is_open, F.lit(False))).unionByName(step(going))
    raise StepLimit(f"not done after {limit} steps")


def within_limit(steps: DataFrame, thread: str, limit: int = STEP_LIMIT) -> DataFrame:
    """A log of steps per thread: how many ran, and whether the limit stopped it."""
    return steps.groupBy(thread).agg(F.least(F.count("*"), F.lit(limit)).alias("n_steps"), (F.count("*") > limit).alias("is_stopped"))
