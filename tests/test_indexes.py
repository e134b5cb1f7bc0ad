"""The vector index and the text index against plain searches over everything."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.operators import text_search, vector_index


@pytest.fixture(scope="module")
def clustered(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 24))
    rows = [(k, [float(x) for x in centres[0 if k % 3 == 0 else k % 12] + 0.4 * rnd.normal(size=24)]) for k in range(900)]
    odd = [(900, None), (901, [0.0] * 24), (None, rows[0][1]), (902, rows[5][1]), (903, rows[5][1])]
    return rows + odd, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")


def exact(rows, k):
    known = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v and any(v)]
    ids, m = np.array([i for i, _ in known]), np.stack([v for _, v in known])
    want = {}
    for i, v in known:
        if i % 20 == 0:
            near = sorted((-round(float(s), 6), int(j)) for j, s in zip(ids, m @ v) if j != i)[:k]
            want[i] = [j for _, j in near]
    return want


def found(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.query_id][r.rank] = r.id
    return {q: [ranks[n] for n in sorted(ranks)] for q, ranks in out.items()}


@pytest.mark.parametrize("n_lists", [1, 12])
def test_all_lists_give_the_exact_result(spark, clustered, tmp_path, monkeypatch, n_lists):
    monkeypatch.setattr(vector_index, "TILE", 50)
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    rows, df = clustered
    path = str(tmp_path / "store")
    vector_index.build_index(df, path, n_lists)
    assert found(vector_index.search_index(spark, path, df.where("vec_id % 20 = 0"), 4, n_lists)) == exact(rows, 4)


def test_few_probes_find_most_and_read_their_lists_alone(spark, clustered, tmp_path):
    rows, df = clustered
    path = str(tmp_path / "store")
    vector_index.build_index(df, path, 12)
    want = exact(rows, 4)
    got = found(vector_index.search_index(spark, path, df.where("vec_id % 20 = 0"), 4, 3))
    assert sum(len({*got[q]} & {*want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
    one = vector_index.search_index(spark, path, df.where("vec_id = 20"), 4, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], ", plan)
    assert any(re.search(r"list#\d+ IN \(\d+,\d+\)", f) for f in filters)


def test_recall_on_the_given_embeddings(spark, tmp_path):
    """They are directions drawn at random, without clusters, so most lists have to be probed."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = str(tmp_path / "store")
    vector_index.build_index(e, path)
    queries = e.where("vec_id % 20 = 0")
    want = found(vector_index.search_index(spark, path, queries, 4, vector_index.MOST_LISTS))
    got = found(vector_index.search_index(spark, path, queries, 4, 30))
    recall = sum(len({*got[q]} & {*want[q]}) for q in want) / sum(map(len, want.values()))
    print("recall of 30 probes of 44 lists:", recall)
    assert recall >= 0.95


def bm25(rows, queries, k):
    docs = defaultdict(list)
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    for i, t in rows:
        if i is not None:
            docs[i] += split(t)
    docs = {i: Counter(w) for i, w in docs.items() if w}
    mean = sum(sum(c.values()) for c in docs.values()) / len(docs)
    n_docs = Counter(w for c in docs.values() for w in c)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in docs.items():
            size, s = sum(c.values()), 0.0
            for w in sorted({*split(text)} & {*c}):
                s += math.log(1 + (len(docs) - n_docs[w] + 0.5) / (n_docs[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
            if {*split(text)} & {*c}:
                scores.append((-round(s, 5), i))
        out[q] = [s for s, _ in sorted(scores)[:k]]
    return {q: s for q, s in out.items() if s}


def test_ranked_search_against_scoring_everything_and_blocks_are_skipped(spark, tmp_path):
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rnd.choices(vocabulary[: 20 + 280 * (k % 7 == 0)], k=rnd.randrange(1, 40)))) for k in range(2000)]
    rows += [(None, "w1"), (5, "w250 w250, W250!"), (3000, None), (3001, "")]
    queries = [(1, "w250 w1"), (2, "w290 w280 unknown"), (3, "w3 w4 w5 w6"), (4, "nothing here"), (5, None)]
    path = str(tmp_path / "index")
    text_search.build_text_index(spark.createDataFrame(rows, "doc_id long, text string"), path, id_range=16)
    found, parts = text_search.search_parts(spark, path, spark.createDataFrame(queries, "query_id long, text string"), 3)
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(-round(r.score, 5))
    want = bm25(rows, queries, 3)
    assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q], abs=2e-5) for q in want)
    skipped = {r.query_id: r["count"] for r in parts.where("part = 0").groupBy("query_id").count().collect()}
    assert skipped[1] > 50


def test_an_empty_index_finds_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, vec_id long, embedding array<double>")
    text_search.build_text_index(none, str(tmp_path / "t"))
    assert text_search.search_text(spark, str(tmp_path / "t"), spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0
    assert vector_index._searchable(none, "vec_id", "embedding").count() == 0
