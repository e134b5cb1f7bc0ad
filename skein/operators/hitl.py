"""Human decisions about tool calls: which calls wait, what may be decided, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Messages of decisions that can't be built.
NO_REASON = "A reason is needed to reject."
NO_CHANGE = "Nothing was changed."
NOT_ALLOWED = "This decision is not allowed."
NOT_ALL = "Every action needs a decision."


def waiting_calls(calls: DataFrame, config: DataFrame, name: str = "tool_name") -> DataFrame:
    """Calls with ``is_waiting``: true if the configuration (tool_name, must_ask) lists their tool so; unlisted tools run."""
    return calls.join(config.select(F.col("tool_name").alias("__t"), "must_ask"), F.col(name) == F.col("__t"), "left").withColumn(
        "is_waiting", F.coalesce("must_ask", F.lit(False))
    ).drop("__t", "must_ask")


def config_of_actions(requests: DataFrame, fallback: str = "first") -> DataFrame:
    """Each action with its review configuration: the first of its name, else by place (``first`` or ``same``).

    Columns: request_id, actions (array of names), configs (array of struct<action_name, allowed>).
    """
    actions = requests.select("request_id", "configs", F.posexplode("actions").alias("place", "action"))
    match = F.get(F.filter("configs", lambda c: c["action_name"] == F.col("action")), F.lit(0))
    other = F.get("configs", F.lit(0)) if fallback == "first" else F.get("configs", F.col("place"))
    return actions.select("request_id", "place", "action", F.coalesce(match, other)["allowed"].alias("allowed"))


def default_decision(allowed: Column) -> Column:
    """approve before reject before edit; null without any."""
    return F.coalesce(*[F.when(F.array_contains(allowed, d), F.lit(d)) for d in ("approve", "reject", "edit")])


def offered(allowed: Column) -> Column:
    """The decisions in the order in which they are shown."""
    return F.filter(F.array(*map(F.lit, ("edit", "approve", "reject"))), lambda d: F.array_contains(allowed, d))


def args_changed(initial: Column, edited: Column) -> Column:
    """Whether any edited argument differs from the initial one; a key that is missing there counts as changed."""
    return F.exists(F.map_entries(edited), lambda e: ~e["value"].eqNullSafe(F.try_element_at(initial, e["key"])) | ~F.map_contains_key(initial, e["key"]))


def reset_args(edited: Column, initial: Column) -> Column:
    """Edited arguments put back; keys that aren't being edited are not added."""
    return F.transform_values(edited, lambda k, v: F.coalesce(F.try_element_at(initial, k), v))


def build_decision(kind: Column, allowed: Column, reason: Column, changed: Column) -> Column:
    """The decision to send: struct<type, message, error>. An edit without change is an approval where that is allowed."""
    text = F.trim(F.coalesce(reason, F.lit("")))
    may = F.array_contains(allowed, kind)
    none = F.lit(None).cast("string")
    made = lambda t, m, e: F.struct(t.alias("type"), m.alias("message"), e.alias("error"))
    return (
        F.when(~F.coalesce(may, F.lit(False)), made(none, none, F.lit(NOT_ALLOWED)))
        .when((kind == "reject") & (text == ""), made(none, none, F.lit(NO_REASON)))
        .when(kind == "reject", made(F.lit("reject"), text, none))
        .when((kind == "edit") & ~changed & F.array_contains(allowed, "approve"), made(F.lit("approve"), none, none))
        .when((kind == "edit") & ~changed, made(none, none, F.lit(NO_CHANGE)))
        .otherwise(made(kind, none, none))
    )


def submit_type(changed: Column, allowed: Column, has_text: Column) -> Column:
    """What a form sends: changed arguments are an edit; else approval if allowed; else rejection if a text was given."""
    return F.when(changed, "edit").when(F.array_contains(allowed, "approve"), "approve").when(has_text, "reject")


def apply_decision(pending: DataFrame) -> DataFrame:
    """Calls after their decision: name, args, whether it runs, and the message to the model if not.

    Columns: tool_name, args, decision struct<type, message, edited_name, edited_args>.
    """
    d = F.col("decision")
    edit, reject = d["type"] == "edit", d["type"] == "reject"
    return (
        pending.withColumn("run_name", F.when(edit, F.coalesce(d["edited_name"], "tool_name")).when(~reject, F.col("tool_name")))
        .withColumn("run_args", F.when(edit, d["edited_args"]).when(~reject, F.col("args")))
        .withColumn("is_run", ~F.coalesce(reject, F.lit(False)))
        .withColumn("reply", F.when(reject, d["message"]))
    )


def all_approvable(actions: DataFrame) -> DataFrame:
    """Per request: whether every one of several actions may be approved (false for a single one, or one without configuration)."""
    may = F.coalesce(F.array_contains("allowed", "approve"), F.lit(False))
    return actions.groupBy("request_id").agg((F.min(may) & (F.count("*") > 1)).alias("all_approvable"), F.count("*").alias("n_actions"))


def decisions_complete(decided: DataFrame, actions: DataFrame) -> DataFrame:
    """Per request: whether each action's place has a decision, no place twice."""
    have = decided.groupBy("request_id").agg(F.countDistinct("place").alias("n_places"), F.count("*").alias("n_decisions"))
    want = actions.groupBy("request_id").agg(F.count("*").alias("n_actions"))
    return want.join(have, "request_id", "left").select(
        "request_id", F.coalesce((F.col("n_places") == F.col("n_actions")) & (F.col("n_decisions") == F.col("n_actions")), F.lit(False)).alias("is_complete")
    )


def resolve_choice(answer: Column, options: Column) -> Column:
    """An answer that is a number from 1 to the number of options is that option; any other stays as it is."""
    n = F.when(answer.rlike("^[0-9]{1,9}$"), answer.try_cast("int"))
    return F.when((n >= 1) & (n <= F.size(options)), F.try_element_at(options, n)).otherwise(answer)


def valid_request(actions: Column, configs: Column) -> Column:
    return F.coalesce((F.size(actions) > 0) & (F.size(configs) > 0), F.lit(False))


def has_several(responses: Column) -> Column:
    """Whether there is more than one response to choose from."""
    return F.coalesce(F.size(present(responses)) > 1, F.lit(False))


def present(interrupts: Column) -> Column:
    """A list of interrupts without nulls."""
    return F.filter(interrupts, lambda x: x.isNotNull())


def submit_all(decided: DataFrame, actions: DataFrame) -> DataFrame:
    """Per request of several actions: its decisions in the order of its actions, or the error that some are missing.

    ``decided``: request_id, place, decision (the last of a place counts: columns may have ``seq``); ``actions``: request_id,
    place. A request of one action isn't submitted this way and gives no row.
    """
    order = F.col("seq") if "seq" in decided.columns else F.lit(0)
    last = decided.groupBy("request_id", "place").agg(F.max_by("decision", F.struct(order, "decision")).alias("decision"))
    rows = actions.select("request_id", "place").join(last, ["request_id", "place"], "left").groupBy("request_id").agg(
        F.count("*").alias("n"), F.count("decision").alias("n_decided"), F.sort_array(F.collect_list(F.when(F.col("decision").isNotNull(), F.struct("place", "decision")))).alias("d")
    )
    full = F.col("n_decided") == F.col("n")
    return rows.where("n > 1").select(
        "request_id", F.when(full, F.transform("d", lambda x: x["decision"])).alias("decisions"), F.when(~full, F.lit(NOT_ALL)).alias("error")
    )


def serve_questions(interrupts: DataFrame, answers: DataFrame, tool: str = "ask_user_input") -> DataFrame:
    """The ask-user loop over a log: what each round of a thread is resumed with.

    ``interrupts``: thread_id, round, request_no, question, options, allow_freetext (null: true). Only the first request of a
    round is served. ``answers``: thread_id, round, answer; blanks around it are dropped, and a number names an option.
    Returns thread_id, round, type, name, question, options, allow_freetext, user_answer (null: still waiting) and is_last.
    """
    first = interrupts.groupBy("thread_id", "round").agg(F.min_by(F.struct("question", "options", "allow_freetext"), "request_no").alias("q"))
    last = interrupts.groupBy("thread_id").agg(F.max("round").alias("last_round"))
    given = answers.select("thread_id", "round", F.trim("answer").alias("answer"))
    return first.join(given, ["thread_id", "round"], "left").join(last, "thread_id").select(
        "thread_id",
        "round",
        F.lit("edit").alias("type"),
        F.lit(tool).alias("name"),
        "q.question",
        "q.options",
        F.coalesce("q.allow_freetext", F.lit(True)).alias("allow_freetext"),
        resolve_choice(F.col("answer"), F.col("q.options")).alias("user_answer"),
        (F.col("round") == F.col("last_round")).alias("is_last"),
    )


def resolve_threads(threads: DataFrame, resolved: DataFrame) -> DataFrame:
    """``threads`` (thread_id, status, next) with those of ``resolved`` (thread_id) sent to their end: nothing is next, no decision is taken."""
    marks = resolved.select("thread_id", F.lit(True).alias("is_resolved")).distinct()
    done = F.coalesce("is_resolved", F.lit(False))
    return threads.join(marks, "thread_id", "left").select(
        "thread_id", F.when(done, F.lit("resolved")).otherwise(F.col("status")).alias("status"), F.when(~done, F.col("next")).alias("next")
    )
