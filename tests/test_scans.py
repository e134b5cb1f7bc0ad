"""Scans, theta joins, branch states and summary rounds against plain versions, and how evenly they are spread."""

import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from skein.operators import branches, theta
from skein.operators.context_window import summary_rounds
from skein.operators.scan import asof_scan, prefix_scan, with_cuts


def test_scan_against_a_loop(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 9 + ["a", "b", None]), k, rnd.choice([None, rnd.randrange(9)]), rnd.choice([None, f"v{k}"])) for k in rnd.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "key string, at long, x long, v string").repartition(5)
    want, sums, lasts = [], {}, {}
    for key, at, x, v in sorted(rows, key=lambda r: r[1]):
        if x is not None:
            sums[key] = sums.get(key, 0) + x
        if v is not None:
            lasts[key] = v
        want.append((key, at, x, v, sums.get(key), lasts.get(key)))
    for cut_rows in (10, 50, 10**6):
        got = prefix_scan(df, ["key"], ["at"], {"total": F.col("x")}, {"last": F.col("v")}, cut_rows)
        assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert prefix_scan(df.limit(0), ["key"], ["at"], {"total": F.col("x")}, cut_rows=1).count() == 0


def test_a_hot_key_is_cut_evenly(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 10 < 9, -1).otherwise(F.col("id")).alias("key"), "id")
    cut, some = with_cuts(df, ["key"], "id", 1000)
    sizes = [r["count"] for r in cut.where("key = -1").groupBy("__cut").count().collect()]
    assert some and len(sizes) == 45 and max(sizes) <= 2 * median(sizes)
    assert cut.where("key <> -1 and __cut <> 0").count() == 0


def test_asof_with_ties_and_nulls(spark):
    rnd = random.Random(2)
    left = [(k, rnd.choice([1, 1, 1, 2, None]), rnd.randrange(40)) for k in range(200)]
    right = [(rnd.choice([1, 1, 2, 3]), rnd.randrange(40), k, rnd.choice([None, "x", "y"])) for k in range(150)]
    a = spark.createDataFrame(left, "id long, key long, at long")
    b = spark.createDataFrame(right, "key long, t long, no long, v string")
    want = []
    for i, key, at in left:
        hits = [(t, no, v) for k, t, no, v in right if k == key and t <= at]
        want.append((i, key, at, *(max(hits, key=lambda h: h[:2])[1:] if hits else (None, None))))
    for cut_rows in (20, 10**6):
        assert Counter(tuple(r) for r in asof_scan(a, b, "key", ["at", "id"], ["t", "no"], ["no", "v"], cut_rows).collect()) == Counter(want)


@pytest.mark.parametrize("ops", [("<",), (">=",), ("<=", ">"), (">", "<=", "<")])
def test_theta_join_against_all_pairs(spark, ops):
    rnd = random.Random(len(ops))
    draw = lambda n: [(k, *[rnd.choice([None, 7, 7, 7, 7, 7, 7, 7, 7, rnd.randrange(60)]) for _ in range(3)]) for k in range(n)]
    left, right = draw(120), draw(90)
    holds = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    want = Counter((x[0], y[0]) for x in left for y in right if all(x[i + 1] is not None and y[i + 1] is not None and holds[op](x[i + 1], y[i + 1]) for i, op in enumerate(ops)))
    a = spark.createDataFrame(left, "i long, x0 long, x1 long, x2 long")
    b = spark.createDataFrame(right, "j long, y0 long, y1 long, y2 long")
    conditions = [(f"x{i}", op, f"y{i}") for i, op in enumerate(ops)]
    for pairs in (100, 10**6):
        got = theta.theta_join(a, b, conditions, pairs)
        assert Counter(tuple(r) for r in got.select("i", "j").collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert theta.theta_join(a.limit(0), b, conditions).count() == 0


def test_regions_are_even_with_a_skewed_value(spark):
    value = F.when(F.col("id") % 2 == 0, 500).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)))
    a = spark.range(20_000).select(value.alias("x"))
    b = spark.range(5_000).select(value.alias("y"))
    left, right = theta.regions(a, b, [("x", "<=", "y")], 250_000)
    n = {r["__region"]: r["count"] for r in left.groupBy("__region").count().collect()}
    m = {r["__region"]: r["count"] for r in right.groupBy("__region").count().collect()}
    work = [n[k] * m[k] for k in n]
    assert n.keys() == m.keys() and max(work) <= 2 * median(work)


def tree(rnd, n):
    return [(k, None if k == 0 or rnd.random() < 0.03 else rnd.randrange(max(0, k - 4), k)) for k in range(n)]


def test_state_at_every_checkpoint(spark):
    rnd = random.Random(5)
    nodes = [(t, k, p, rnd.randrange(3)) for t in (1, 2, 3) for k, p in tree(rnd, 70)]
    nodes += [(4, 1, 99, 0), (4, 2, 1, 0), (5, 1, 2, 0), (5, 2, 1, 0), (5, 3, None, 0)]  # below nothing; a cycle beside a root
    changes = [(t, k, rnd.choice("abc"), rnd.choice([None, "x", f"{t}-{k}"]), s) for t, k, _, _ in nodes for s in range(rnd.randrange(3))]
    checkpoints = spark.createDataFrame(nodes, "thread_id long, checkpoint_id long, parent_id long, seq long")
    updates = spark.createDataFrame(changes, "thread_id long, checkpoint_id long, key string, value string, seq long")
    parents = {(t, k): p for t, k, p, _ in nodes}
    latest = {}
    for t, k, key, value, s in changes:
        place = latest.setdefault((t, k), {})
        place[key] = max(place.get(key, (-1,)), (s, value is not None, value or ""))
    want = set()
    for t, k, _, _ in nodes:
        state, at, seen = {}, k, set()
        while at is not None and (t, at) in parents and at not in seen:
            seen.add(at)
            for key, (_, known, value) in latest.get((t, at), {}).items():
                state.setdefault(key, value if known else None)
            at = parents[t, at]
        if at is None:
            want |= {(t, k, key, value) for key, value in state.items()}
    for cut_rows in (20, 10**6):
        assert {tuple(r) for r in branches.state_at(checkpoints, updates, cut_rows=cut_rows).collect()} == want
    asked = spark.createDataFrame([(1, 60), (2, 3), (2, 3), (9, 9)], "thread_id long, checkpoint_id long")
    assert {tuple(r) for r in branches.state_at(checkpoints, updates, asked).collect()} == {w for w in want if w[:2] in {(1, 60), (2, 3)}}


def test_labels_nest_as_branches_do(spark):
    nodes = [(1, k, p, k) for k, p in tree(random.Random(6), 60)]
    labels = {r.checkpoint_id: r for r in branches.tour_labels(spark.createDataFrame(nodes, "thread_id long, checkpoint_id long, parent_id long, seq long")).collect()}
    parents = {k: p for _, k, p, _ in nodes}
    for k in parents:
        above, at = set(), k
        while at is not None:
            above.add(at)
            at = parents[at]
        assert above == {a for a, r in labels.items() if r.entered <= labels[k].entered <= r.left}


def test_summary_rounds_against_a_loop(spark):
    rnd = random.Random(7)
    rows = [(t, 3 * k, "x" * rnd.choice([0, 1, 30, 90, 400])) for t, n in ((1, 400), (2, 1), (3, 17)) for k in range(n)] + [(3, 999, None)]
    want, state = set(), {}
    for t, seq, text in sorted(rows, key=lambda r: r[:2]):
        size = -(-len(text or "") // 4)
        number, total = state.get(t, (1, 0))
        want.add((t, seq, size, number, total + size, total + size > 100))
        state[t] = (number + 1, 0) if total + size > 100 else (number, total + size)
    df = spark.createDataFrame(rows, "thread_id long, seq long, content string").repartition(3)
    for cut_rows in (25, 10**6):
        assert {tuple(r) for r in summary_rounds(df, 100, cut_rows).collect()} == want
    assert summary_rounds(df.limit(0)).count() == 0
