"""Stored sketches, the keyed table and unanswered calls as a stream."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import sketches
from skein.sources.upsert import KeyedTable
from skein.streaming import streams


def test_merged_sketches_are_near_exact_values_of_any_range(spark):
    rows = spark.range(300_000).select(
        (F.col("id") % 30).alias("day"), F.pmod(F.xxhash64("id"), F.lit(90_000)).alias("user"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1000).alias("value")
    )
    stored = sketches.sketches(rows, ["day"], "user", "value").cache()
    for low, high in ((0, 30), (3, 11), (29, 30)):
        some = rows.where(f"day >= {low} and day < {high}")
        got = sketches.merged(stored.where(f"day >= {low} and day < {high}"), [F.lit(0).alias("k")], {"median": 0.5, "high": 0.95}).first()
        n, users = some.agg(F.count("*"), F.countDistinct("user")).first()
        assert got.n == n and abs(got.n_distinct - users) <= 4 * 1.04 / 2 ** (sketches.REGISTERS / 2) * users
        for rank, value in ((0.5, got.median), (0.95, got.high)):
            assert abs(some.where(F.col("value") <= value).count() / n - rank) <= 0.003


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([(1, None, None)], "k long, user long, value double")
    assert tuple(sketches.merged(sketches.sketches(none, ["k"], "user", "value"), ["k"], {"median": 0.5}).first()) == (1, 1, 0, None)
    assert sketches.merged(sketches.sketches(none.limit(0), ["k"], "user", "value"), ["k"], {}).count() == 0


SCHEMA = "key string, at long, text string"


def test_batches_in_any_order_and_again(spark, tmp_path):
    rnd = random.Random(1)
    table = KeyedTable(spark, str(tmp_path / "t"), ["key"], ["at"], 5)
    assert table.read() is None
    want, old = {}, []
    for batch in range(6):
        rows = [(rnd.choice([None, *"abcdefghij"]), rnd.randrange(50), f"{batch}-{k}") for k in range(rnd.randrange(1, 9))]
        rows = list({(k, at): (k, at, t) for k, at, t in rows}.values())
        assert table.merge(spark.createDataFrame(rows, SCHEMA), batch)
        old.append(rows)
        for key, at, text in rows:
            if key not in want or at >= want[key][0]:
                want[key] = at, text
        again = rnd.randrange(batch + 1)
        assert not table.merge(spark.createDataFrame(old[again], SCHEMA), again)
        assert {(r.key, (r["at"], r.text)) for r in table.read().collect()} == set(want.items()) and table.read().count() == len(want)
    assert table.merge(spark.createDataFrame([("z", 1, "w")], SCHEMA), 0, "another writer") and table.read().count() == len(want) + 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["key"], ["at"], 16)
    table.merge(spark.createDataFrame([(str(k), 0, "x") for k in range(200)], SCHEMA), 0)
    before = table.manifest()["buckets"]
    table.merge(spark.createDataFrame([("7", 1, "y")], SCHEMA), 1)
    after = table.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in after) == 1 and table.read().count() == 200


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    def write(k):
        table = KeyedTable(spark, str(tmp_path / "t"), ["key"], ["at"], 4)
        return table.merge(spark.createDataFrame([(f"{k}-{j}", 1, "x") for j in range(5)] + [("all", k, f"of {k}")], SCHEMA), 0, f"writer {k}")

    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(write, range(4)))
    table = KeyedTable(spark, str(tmp_path / "t"), ["key"], ["at"])
    assert table.read().count() == 21 and table.read().where("key = 'all'").first().text == "of 3" and table.manifest()["version"] == 4


def test_a_merge_that_broke_off_leaves_the_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["key"], ["at"], 4)
    table.merge(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    (tmp_path / "t" / "_versions" / "000000000002.json").write_text('{"version": 2, "buck')
    (tmp_path / "t" / "data" / "half").mkdir()
    assert table.manifest()["version"] == 1 and table.read().count() == 1


@pytest.mark.parametrize("late", ["10 minutes"])
def test_unanswered_calls_as_a_stream_with_a_restart(spark, tmp_path, late):
    start, rnd = datetime(2024, 1, 1), random.Random(3)
    calls = [(k % 5, k, start + timedelta(minutes=k)) for k in range(300)]
    answers = [(k, at + timedelta(minutes=rnd.choice([0, 3, 29, 31, 45]))) for _, k, at in calls if rnd.random() < 0.7]
    end = [(9, 999, start + timedelta(days=1))], [(999, start + timedelta(days=1))]
    kinds = "thread_id long, call_id long, ts timestamp", "call_id long, ts timestamp"
    folders, out, state = [str(tmp_path / n) for n in ("calls", "answers")], str(tmp_path / "out"), str(tmp_path / "state")

    def add(*parts):
        for rows, kind, folder in zip(parts, kinds, folders):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)

    def run():
        a, b = (spark.readStream.schema(k).parquet(f) for k, f in zip(kinds, folders))
        stream = streams.unanswered_calls(a, b, 1800, late)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    cut = start + timedelta(minutes=150)
    add([c for c in calls if c[2] < cut], [a for a in answers if a[1] < cut])
    run()
    add([c for c in calls if c[2] >= cut], [a for a in answers if a[1] >= cut])
    run()
    add(*end)
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    batch = streams.unanswered_calls(*(spark.createDataFrame(r, k) for r, k in zip((calls, answers), kinds)), 1800)
    want = sorted(tuple(r) for r in batch.collect())
    assert got == want and 60 < len(want) < 250
