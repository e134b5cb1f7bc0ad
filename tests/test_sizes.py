"""Queries against their SQL on tables of more rows or other shapes than the given ones."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import rows

from skein.operators import sketches, text_search
from skein.operators.context_window import summary_rounds
from skein.operators.scan import with_cuts
from skein.plans import catalogue


def agrees(spark, folder, name, **tables):
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
    got = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(catalogue.SQL[name])
    names = [x[0] for x in want.description]
    return rows(got.columns, got.collect()) == rows(names, want.fetchall())


def events(spark, n):
    """Two kinds of events over 20 days, with more different users and values than a sketch counts one by one."""
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        F.to_timestamp_ntz(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 61 % 1_728_000)).alias("ts"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(70_000))).alias("user_id"),
        F.when(F.col("id") % 10 < 9, "view").otherwise("click").alias("event_type"),
        F.when(F.col("id") % 40 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1000).alias("value"),
        F.lit("{}").alias("props"),
    )


def test_distinct_counts_are_exact_beyond_the_registers_of_a_sketch(spark, tmp_path):
    assert agrees(spark, tmp_path, "q_approx_distinct", events=events(spark, 600_000))


def test_stored_sketches_are_exact_with_more_values_than_they_keep(spark, tmp_path):
    assert agrees(spark, tmp_path, "q_sketch_rollup", events=events(spark, 600_000))


def test_exact_merges_of_awkward_values_and_any_cuts(spark, tmp_path):
    rnd = random.Random(9)
    some = [None, -1.0, 0.0, 2.5, 7.0, float("inf"), float("nan")]
    data = [(rnd.choice(["a", "b", None]), k % 5, rnd.choice([None, "u", "v", f"m{k}"]), rnd.choice([*some, float(k)])) for k in range(900)] + [("none", 1, None, None)]
    sketches.store(spark.createDataFrame(data, "key string, day long, member string, value double"), ["key", "day"], "member", "value", str(tmp_path))
    order = lambda v: (math.isnan(v), v)
    want = set()
    for key in {r[0] for r in data}:
        values = sorted((v for k, _, _, v in data if k == key and v is not None), key=order)
        picks = [str(values[max(math.ceil(len(values) * p / 100), 1) - 1]) if values else "None" for p in (0, 10, 50, 100)]
        want.add((key, sum(r[0] == key for r in data), len({r[2] for r in data if r[0] == key} - {None}), *picks))
    for cut_rows in (1, 50, 280, 10**6):
        got = sketches.exactly_merged(spark, str(tmp_path), ["key"], {"least": 0.0, "low": 0.1, "median": 0.5, "most": 1.0}, cut_rows).collect()
        assert {(*r[:3], *map(str, r[3:])) for r in got} == want and len(got) == len(want)
    assert {tuple(r) for r in sketches.exactly_merged(spark, str(tmp_path), ["key"], {}).collect()} == {w[:3] for w in want}


def shuffled_records(spark):
    """Records that all stages so far have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_a_text_index_shuffles_its_postings_once(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(5000)).cast("string"))).alias("text"))
    n = docs.select("doc_id", F.explode(F.array_distinct(text_search.words(F.col("text"))))).count()
    before = shuffled_records(spark)
    text_search.build_text_index(docs, str(tmp_path / "index"))
    found = text_search.search_text(spark, str(tmp_path / "index"), docs.where("doc_id < 5").withColumnRenamed("doc_id", "query_id"), 3).collect()
    assert [r.doc_id for r in found if r["rank"] == 1] == [r.query_id for r in found if r["rank"] == 1] and len(found) == 15
    assert shuffled_records(spark) - before < 2 * n


def test_rows_of_one_document_are_counted_together_and_many_tasks_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_search, "TASK", 20)
    rnd = random.Random(5)
    data = [(rnd.randrange(60), rnd.choice([None, "", " ".join(rnd.choices("abcdefghij", k=rnd.randrange(1, 30)))]), "en", "s", 0) for _ in range(90)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    benchmark = spark.createDataFrame([(20, "a b c"), (40, "j"), (41, "a"), (60, "none")], "item_id long, text string")
    assert agrees(spark, tmp_path, "q_bm25", documents=docs, benchmark=benchmark)


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup(str(work), "")
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(work)))


@pytest.mark.parametrize("most, sizes", [(30, [0, 4]), (10, [0, 0, 0, 3, 170]), (10_000, [1, 40]), (0, [0, 1])])
def test_rounds_of_long_threads_agree_with_a_loop_in_as_many_jobs(spark, most, sizes):
    rnd = random.Random(most)
    data = [(t, k * 2, "x" * rnd.choice(sizes)) for t, n in (("a", 3000), (None, 2000), ("b", 101), ("c", 1), ("d", 100)) for k in range(n)]
    want, state = set(), {}
    for t, seq, text in data:
        size = -(-len(text) // 4)
        number, total = state.get(t, (1, 0))
        want.add((t, seq, size, number, total + size, total + size > most))
        state[t] = (number + 1, 0) if total + size > most else (number, total + size)
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "thread_id string, seq long, content string").repartition(5)
    for cut_rows in (100, 10**6):
        found, n_jobs = jobs_of(spark, lambda n=cut_rows: {tuple(r) for r in summary_rounds(df, most, n).collect()})
        assert found == want and n_jobs < 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {tuple(r) for r in summary_rounds(df, most, 500).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cuts_are_found_by_halving(spark):
    """A key of as many cuts as there can be: rows of a cut are as many as its place says."""
    df = spark.range(5000).select((F.col("id") % 2).alias("key"), "id")
    cut, some = with_cuts(df, ["key"], "id", 1)
    assert some
    for r in cut.groupBy("key").agg(F.count_distinct("__cut").alias("n"), F.max("__cut").alias("most"), F.corr(F.col("__cut"), F.col("id")).alias("c")).collect():
        assert r.n == r.most + 1 and r.n > 900 and r.c > 0.999
