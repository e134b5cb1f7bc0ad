"""Small fixtures, truth tables and properties."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.operators import context_window, hitl, relational, retrieval, routing, state, trace
from skein.sources import calls
from skein.sources.registry import merge_registries, prompt_of, registry, tool


def log(spark, roles, thread=1):
    rows = [(thread, i, str(i), r, f"text {i} " + "x" * 60) for i, r in enumerate(roles)]
    return spark.createDataFrame(rows, "thread_id long, seq long, id string, role string, content string")


def test_summary_leaves_two_messages_with_the_summary_first(spark):
    nine = log(spark, ["human", "ai"] * 4 + ["human"])
    out = context_window.summarise(nine).orderBy("place").collect()
    assert [r.role for r in out] == ["summary", "human"] and out[1].content.startswith("text 8")


def test_short_threads_are_not_summarised(spark):
    assert context_window.summarise(log(spark, ["human"])).collect()[0].role == "human"


def test_removing_tool_messages_keeps_five_in_order(spark):
    seven = log(spark, ["human", "tool", "ai", "human", "tool", "ai", "human"])
    left = trace.remove_messages(seven, trace.of_role(seven, "tool")).orderBy("seq").collect()
    assert [r.seq for r in left] == [0, 2, 3, 5, 6]


@pytest.mark.parametrize("n,model", [(1, "standard"), (10, "standard"), (11, "large")])
def test_routing_by_length(spark, n, model):
    assert spark.range(1).select(routing.route_model(F.lit(n))).first()[0] == model


def test_hidden_messages_keep_null_ids(spark):
    df = spark.createDataFrame([("do-not-render-1", "ai"), ("2", "tool"), (None, "ai")], "id string, role string")
    assert [r.id for r in trace.visible(df).collect()] == ["2", None]
    assert [r.id for r in trace.visible(df, hide_tools=True).collect()] == [None]


def test_orphans_get_answers(spark):
    df = spark.createDataFrame(
        [(1, 0, 10, "ai", "t", None), (1, 1, 11, "tool", None, 10), (1, 2, 12, "ai", "t", None)],
        "thread_id long, seq long, id long, role string, tool_name string, tool_call_id long",
    )
    assert [r.tool_call_id for r in trace.answers_for_orphans(df).collect()] == [12]


def test_fold_takes_the_last_and_repeats_change_nothing(spark):
    rows = [(1, "a", 1, 1, "x"), (1, "a", 2, 2, "y"), (1, "b", 1, 3, "z")]
    df = spark.createDataFrame(rows, "thread_id long, key string, seq long, id long, value string")
    once = {tuple(r) for r in state.fold_updates(df).collect()}
    assert once == {(1, "a", "y"), (1, "b", "z")} == {tuple(r) for r in state.fold_updates(df.union(df)).collect()}
    wide = state.as_state(state.fold_updates(df), ["a", "b", "c"]).first()
    assert (wide.a, wide.b, wide.c) == ("y", "z", None)


def test_seeds_come_before_updates(spark):
    updates = spark.createDataFrame([(1, "a", "new", 0, 0)], "thread_id long, key string, value string, seq long, id long")
    seeds = spark.createDataFrame([(1, "a", "old"), (1, "b", "seed")], "thread_id long, key string, value string")
    assert {tuple(r) for r in state.fold_updates(state.seeded(seeds, updates)).collect()} == {(1, "a", "new"), (1, "b", "seed")}


def test_branches_are_bounded(spark):
    df = spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 1), (1, 3, 1, 2), (1, 4, 2, 3)], "thread_id long, checkpoint_id long, parent_id long, seq long")
    assert {r.path for r in state.branch_paths(df).collect()} == {"1", "1/2", "1/3", "1/2/4"}
    looped = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 4), (1, 4, 3), (1, 5, 99), (2, 1, None)], "thread_id long, checkpoint_id long, parent_id long")
    assert {(r.thread_id, r.path) for r in state.branch_paths(looped).collect()} == {(1, "1"), (1, "1/2"), (2, "1")}
    assert state.branch_paths(looped.limit(0)).count() == 0


def test_long_branches(spark):
    df = spark.range(300).select(F.lit(1).alias("thread_id"), F.col("id").alias("checkpoint_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    deepest = state.branch_paths(df).orderBy(F.desc("depth")).first()
    assert (deepest.depth, deepest.path) == (299, "/".join(map(str, range(300))))


def test_interval_join_against_all_pairs(spark):
    stamps = [0, 1, 59, 60, 61, 119, 120, 121, 3600, 3600]
    of = lambda name, at: spark.createDataFrame([(k % 2, i, t) for k in range(2) for i, t in enumerate(stamps)] + [(None, 99, 0)], f"k long, {name} long, s long").select(
        "k", name, F.timestamp_seconds("s").alias(at)
    )
    got = relational.interval_join(of("a", "x"), of("b", "y"), "k", "x", "y", 60).select("k", "a", "b").collect()
    want = [(k, i, j) for k in range(2) for i, s in enumerate(stamps) for j, t in enumerate(stamps) if 0 <= t - s <= 60]
    assert sorted(map(tuple, got)) == sorted(want)


def test_decisions_for_every_subset(spark):
    kinds = ["approve", "edit", "reject"]
    rows = [(list(s),) for n in range(4) for s in itertools.combinations(kinds, n)]
    df = spark.createDataFrame(rows, "allowed array<string>")
    for r in df.select("allowed", hitl.default_decision(F.col("allowed")).alias("d"), hitl.offered(F.col("allowed")).alias("o")).collect():
        assert r.d == next((k for k in ("approve", "reject", "edit") if k in r.allowed), None)
        assert r.o == [k for k in ("edit", "approve", "reject") if k in r.allowed]


def test_built_decisions(spark):
    rows = [
        (k, list(a), reason, changed)
        for k in ("approve", "edit", "reject")
        for n in range(4)
        for a in itertools.combinations(("approve", "edit", "reject"), n)
        for reason in (None, " ", " why ")
        for changed in (True, False)
    ]
    df = spark.createDataFrame(rows, "kind string, allowed array<string>, reason string, changed boolean")
    made = hitl.build_decision(F.col("kind"), F.col("allowed"), F.col("reason"), F.col("changed"))
    for r in df.withColumn("m", made).collect():
        if r.kind not in r.allowed:
            assert r.m.error == hitl.NOT_ALLOWED
        elif r.kind == "reject":
            blank = not (r.reason or "").strip()
            assert (r.m.error, r.m.type, r.m.message) == ((hitl.NO_REASON, None, None) if blank else (None, "reject", "why"))
        elif r.kind == "edit" and not r.changed:
            assert (r.m.type, r.m.error) == (("approve", None) if "approve" in r.allowed else (None, hitl.NO_CHANGE))
        else:
            assert (r.m.type, r.m.error) == (r.kind, None)


def test_action_configs_fall_back_in_two_ways(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b", "c"], [("b", ["edit"]), ("x", ["approve"]), ("b", ["reject"])])],
        "request_id long, actions array<string>, configs array<struct<action_name:string,allowed:array<string>>>",
    )
    first = [r.allowed for r in hitl.config_of_actions(df).orderBy("place").collect()]
    same = [r.allowed for r in hitl.config_of_actions(df, "same").orderBy("place").collect()]
    assert first == [["edit"], ["edit"], ["edit"]] and same == [["edit"], ["edit"], ["reject"]]


def test_single_or_unconfigured_actions_cannot_be_approved_together(spark):
    df = spark.createDataFrame([(1, ["approve"]), (2, ["approve"]), (2, ["approve"]), (3, ["approve"]), (3, None)], "request_id long, allowed array<string>")
    assert {r.request_id: r.all_approvable for r in hitl.all_approvable(df).collect()} == {1: False, 2: True, 3: False}


def test_choices(spark):
    df = spark.createDataFrame([("2",), ("9",), ("0",), ("x",), ("99999999999",), ("",)], "a string")
    picked = [r[0] for r in df.select(hitl.resolve_choice(F.col("a"), F.array(*map(F.lit, "pqrst")))).collect()]
    assert picked == ["q", "9", "0", "x", "99999999999", ""]


def test_apply_decision(spark):
    df = spark.createDataFrame(
        [("mail", "{}", ("approve", None, None, None)), ("mail", "{}", ("reject", "no", None, None)), ("mail", "{}", ("edit", None, "note", '{"a":1}'))],
        "tool_name string, args string, decision struct<type:string,message:string,edited_name:string,edited_args:string>",
    )
    got = [tuple(r) for r in hitl.apply_decision(df).select("run_name", "run_args", "is_run", "reply").collect()]
    assert got == [("mail", "{}", True, None), (None, None, False, "no"), ("note", '{"a":1}', True, None)]


def split_text(text, size, overlap):
    """(start, chunk) of each chunk, step by step."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n:
            for sep in retrieval.SEPARATORS:
                cut = text.rfind(sep, at + overlap + 1, end)
                if cut > 0:
                    end = cut + len(sep)
                    break
        out.append((at, text[at:end]))
        if end >= n:
            break
        least = max(at + 1, end - overlap)
        blank = text.find(" ", least, end)
        at = blank + 1 if 0 <= blank < end - 1 else least
    return out


@pytest.mark.parametrize("size,overlap", [(20, 5), (7, 6), (12, 0), (1000, 200)])
def test_recursive_chunks_against_a_loop(spark, size, overlap):
    import random

    rnd = random.Random(size)
    texts = [None, "", " ", "a", "\n\n", "word " * 500, "x" * 2500]
    texts += ["".join(rnd.choice("ab é. \n😀") for _ in range(rnd.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in retrieval.chunks_recursive(df, size, overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.start_index, r.chunk))
    want = {k: split_text(t, size, overlap) for k, t in enumerate(texts) if t}
    assert got == want
    for k, chunks in want.items():
        assert all(len(c) <= size and texts[k][s : s + len(c)] == c for s, c in chunks)
        assert set().union(*[range(s, s + len(c)) for s, c in chunks]) == set(range(len(texts[k])))


def test_cosine_of_stub_embeddings(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("a b", "c d"), ("", "a")], "x string, y string")
    sims = [r[0] for r in df.select(retrieval.cosine(retrieval.embed_stub(F.col("x")), retrieval.embed_stub(F.col("y")))).collect()]
    assert abs(sims[0] - 1) < 1e-6 and -1 <= sims[1] <= 1 and sims[2] is None


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert retrieval.nearest_batch(empty, empty).count() == 0


def test_nearest_in_blocks_of_any_number(spark, monkeypatch):
    import numpy as np

    for name, value in (("QUERY_BLOCK", 5), ("TILE", 8), ("SHARD", 2)):
        monkeypatch.setattr(retrieval, name, value)
    rnd = np.random.default_rng(1)
    m = np.round(rnd.normal(size=(90, 3)), 1)
    m[40:60] = m[0]  # ties
    ids = [(1 << 60) + 7 * k for k in range(90)]
    df = spark.createDataFrame([*[(i, [float(x) for x in v]) for i, v in zip(ids, m)], (None, [1.0, 2.0, 3.0]), (5, None)], "vec_id long, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for i in range(0, 90, 4):
        near = sorted((-round(float(s), 6), ids[j]) for j, s in enumerate(unit @ unit[i]) if j != i)[:6]
        want[ids[i]] = [j for _, j in near]
    got = {}
    for r in retrieval.nearest_batch(df, df.where(F.col("vec_id").isin([*want])), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_scalars(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\ne", "user_nameField", "x" * 501, "not json", "467|x|4")], "a string, b string, c string, d string, e string")
    r = df.select(
        S.truncate(F.col("a")), S.prettify(F.col("b")), F.length(S.truncate(F.col("c"))), S.json_or_text(F.col("d"), "$.x"), S.roots_of_list(F.col("e")),
        F.size(S.json_entries(F.col("d"))), S.truncate_value(F.lit("https://" + "x" * 200)), S.pretty_date_text(F.lit("no date")), S.without_final_newline(F.lit("a\n\n")),
        S.fence_language(F.lit("language-py x")), S.data_url(F.lit("image/png"), F.lit("abc")), S.structured(F.lit('{"a": 1}'), "a long, b long", ["a", "b"]),
    ).first()
    assert r[0] == "a\nb\nc\nd\n..." and r[1] == "User Name Field" and r[2] == 503 and r[3] == "not json"
    assert round(r[4][0], 6) == 21.610183 and r[4][1] is None and r[4][2] == 2.0
    assert r[5] == 0 and len(r[6]) == 208 and r[7] is None and r[8] == "a\n" and r[9] == "py" and r[10] == "data:image/png;base64,YWJj" and r[11] is None


def test_gates(spark):
    df = spark.createDataFrame([("internal",), ("nobody",), (None,)], "role string")
    got = [(r.role, r.tool) for r in routing.gate_by_role(df).collect()]
    assert got == [("internal", "web_search"), ("internal", "sql_query"), ("nobody", "web_search"), (None, "web_search")]
    logins = spark.createDataFrame([(True,), (False,), (None,)], "a boolean")
    assert [r[0][0] for r in logins.select(routing.gate_by_login(F.col("a"))).collect()] == ["check_inbox", "authenticate", "authenticate"]


def test_retries_wait_and_stop():
    waits, tries = [], iter([calls.RemoteError(calls.RETRY_CODE, "again"), ValueError("x"), None])

    def once():
        e = next(tries)
        if e:
            raise e
        return "done"

    assert calls.call_with_retries(once, sleep=waits.append) == calls.Outcome("done", 3, "ok") and waits == [1.0, 2.0]

    def refuse():
        raise calls.RemoteError(-1, "no")

    assert calls.call_with_retries(refuse, sleep=waits.append) == calls.Outcome("no", 1, "refused") and len(waits) == 2

    def never():
        raise ValueError("x")

    assert calls.call_with_retries(never, sleep=waits.append) == calls.Outcome("x", 3, "exhausted")


def test_uploads(spark):
    schema = "filename string, mime_type string"
    stored = spark.createDataFrame([("a.pdf", "application/pdf"), ("p", "image/png")], schema)
    batch = spark.createDataFrame(
        [("a.pdf", "application/pdf"), ("p", "image/jpeg"), ("q", "image/png"), ("q", "image/png"), ("t", "text/html")], schema
    )
    assert sorted(r.filename + r.mime_type for r in calls.new_uploads(batch, stored).collect()) == ["pimage/jpeg", "qimage/png", "qimage/png"]
    assert calls.new_uploads(batch, stored, within_batch=True).count() == 2


def test_tools(spark):
    @tool
    def square(x: float) -> float:
        """The square of a number."""
        return x * x

    @tool("named", description="other")
    def f(a: str, runtime: object) -> str:
        return a + str(runtime)

    assert square.invoke({"x": 3.0}) == 9.0 and f.invoke({"a": "b"}, runtime=1) == "b1" and f.arguments == {"a": "string"}
    square.register(spark)
    assert spark.sql("SELECT square(4D)").first()[0] == 16.0
    rows = merge_registries([registry(spark, [square]), registry(spark, [f])]).collect()
    assert [(r.name, r.description) for r in rows] == [("square", "The square of a number."), ("named", "other")]
    prompts = spark.createDataFrame([("p", ["first", "second"])], "name string, messages array<string>")
    assert prompt_of(prompts, "p").first()[0] == "first"


def test_asof_join_keeps_all_left_rows(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 9, "c")], "k long, t2 long, v string")
    assert {tuple(r) for r in relational.asof_join(left, right, "k", "t", "t2", ["v"]).collect()} == {(1, 5, "b"), (1, 1, None), (2, 5, None)}
