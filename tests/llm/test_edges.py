"""Null, empty, very long, repeated and clashing rows through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import queries
from skein.llm.decontaminate import benchmark_leaks
from skein.llm.licenses import license_scan
from skein.llm.line_templates import drop_recurring_lines
from skein.llm.mixing import plan_mix
from skein.llm.quality_model import quality_scores
from skein.llm.rules import quality_rules
from skein.llm.secret_scan import fitted, labelled_findings, secret_scan, train
from skein.llm.simhash import simhash_groups
from skein.llm.token_store import token_store
from skein.llm.warc import canonical_url, parse_warc, read_records, read_warc, resolve_revisits

#: columns with the names that operators use inside, besides those of the table
CLASHES = "fp score leaks h range row drops leaf mh t key a b kept_id kept_fp mix_id mix_position shard ids size position component_id".split()
LONG = "w" * 300_000
MANY = "alpha beta gamma delta " * 30_000


def awkward(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    plain = "the first line of some words\nand a second line with password=45bb0d53635bf1b89d in it\nunder the MIT License"
    return awkward(
        spark,
        [
            (1, plain, "en", "a", 1),
            (1, plain, "en", "a", 1),
            (2, plain, None, None, None),
            (None, plain, "en", "b", 1),
            (3, None, "en", "b", 1),
            (4, "", "en", "b", 1),
            (5, " \n\t \x0b", "en", None, 1),
            (6, LONG, "en", "c", 1),
            (7, MANY, "en", "c", 1),
            (8, "naïve – “quoted” İstanbul x̸ <|endoftext|> \x00 1234", "en", "c", 1),
            (9, "one", "", "", 1),
        ],
    ).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 0), (7, 5, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a second line with password"), (2, None), (3, ""), (4, "one"), (None, "two words")], "item_id long, text string")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


OPERATORS = {
    "tokens": lambda d, lab, ben: token_store(d, queries.public_tokenizers.path(queries.TOKENIZER), 2),
    "quality": lambda d, lab, ben: quality_scores(d, lab),
    "simhash": lambda d, lab, ben: simhash_groups(d),
    "licenses": lambda d, lab, ben: license_scan(d),
    "rules": lambda d, lab, ben: quality_rules(d),
    "mixing": lambda d, lab, ben: plan_mix(d),
    "secrets": lambda d, lab, ben: secret_scan(d, train(labelled_findings(d.sparkSession, 400))),
    "lines": lambda d, lab, ben: drop_recurring_lines(d),
    "leaks": lambda d, lab, ben: benchmark_leaks(d, ben),
}
PER_ROW = {"tokens", "quality", "simhash", "licenses", "rules", "mixing", "lines"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(docs, labels, benchmark, name):
    out = OPERATORS[name](docs, labels, benchmark)
    rows = by_id(out)
    if name in PER_ROW:
        assert len(rows) == 11
    ids = [r[out.columns.index("doc_id")] for r in rows]
    assert set(ids) <= {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, docs, labels, benchmark, name):
    none = docs.limit(0)
    assert OPERATORS[name](none, labels.limit(0), benchmark.limit(0)).count() == 0


def test_defined_results(docs, labels, benchmark):
    groups = {(r.doc_id, r.fp): r.component_id for r in simhash_groups(docs).collect()}
    empty = [c for (d, _), c in groups.items() if d in (3, 4, 5)]
    assert empty == [3, 3, 3]
    assert {c for (d, _), c in groups.items() if d in (1, 2, None)} == {1}
    assert {(r.doc_id, r.item_id) for r in benchmark_leaks(docs, benchmark).collect()} == {(1, 1), (2, 1), (None, 1), (9, 4)}
    plan = {r.doc_id: r for r in plan_mix(docs).collect()}
    assert plan[3].size == plan[3].taken == 0 and plan[3].position is None and plan[3].positions == []
    texts = {r.doc_id: r for r in drop_recurring_lines(docs).collect()}
    assert texts[3].text is None and texts[3].n_lines == 0 and texts[2].n_dropped == 3 and texts[1].n_dropped == 0
    assert {r.doc_id: r.labels for r in license_scan(docs).collect()}[2] == "mit"


def test_results_of_tokens_quality_rules_and_secrets(spark, docs, labels):
    stored = {}
    for r in sorted(token_store(docs, queries.public_tokenizers.path(queries.TOKENIZER), 2).collect(), key=lambda r: r.start):
        stored.setdefault(r.doc_id, []).append(r)
    assert [len(stored[k]) for k in (None, 1, 2, 6)] == [1, 2, 1, 1] and stored[None][0].start == 0
    assert stored[3][0].n_tokens == stored[4][0].n_tokens == stored[5][0].n_tokens == 1 and stored[7][0].n_tokens > 120_000
    assert stored[1][0].ids_crc32 == stored[1][1].ids_crc32 == stored[2][0].ids_crc32
    scores = {}
    for r in quality_scores(docs, labels).collect():
        scores.setdefault(r.doc_id, set()).add((r.score, r.held_out))
    assert scores[3] == {(s, r) for s, _ in scores[4] for _, r in scores[3]} and len(scores[1]) == 1 and next(iter(scores[None]))[1] is True
    rules = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert (rules[3].n_words, rules[3].base_failed, rules[3].kept) == (0, True, False) == (rules[4].n_words, rules[4].base_failed, rules[4].kept)
    assert rules[6].n_words == 1 and rules[6].word_chars == 300_000 and rules[7].n_repeat_words == 120_000 and rules[7].base_failed
    found = [r for r in secret_scan(docs, fitted(spark)).collect() if r.is_secret]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 1), (False, 1), (False, 2), (True, 0)] and len({r.value_sha256 for r in found}) == 1


def test_stages_keep_columns_and_take_awkward_rows(spark, docs, labels, benchmark, tmp_path):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    for part in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, part, folder)
            assert out.dtypes == part.dtypes, name
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, part, folder).count() == part.count()
    once = corpus_pipeline.near_dedup(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in once) == [1, 3, 6, 7, 8, 9]


def test_broken_warc(spark):
    data = [(1, None), (2, b""), (3, b"WARC/1.1\r\nno end"), (4, b"WARC/1.1\r\nContent-Length: x\r\n\r\n"), (None, b"noise")]
    df = spark.createDataFrame(data, "k long, data binary")
    assert parse_warc(df, "k", "data").count() == 0
    assert resolve_revisits(parse_warc(df, "k", "data")).count() == 0
    urls = [None, "", "HTTP://User@WWW.A.com:80/x/?b=2&utm_source=f&a=1#top", "https://a.com/x?a=1&b=2", "a.com/x/index.html", "////"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()]
    assert got == [None, "", "a.com/x?a=1&b=2", "a.com/x?a=1&b=2", "a.com/x", ""]


def record(body, length=None, status="200"):
    block = f"HTTP/1.1 {status} OK\r\nETag: x\r\n\r\n".encode() + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {length or len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_broken_tails_end_the_reading():
    import gzip
    import random

    noise = random.Random(1).randbytes(3_000_000)
    good = record(b"one") + record(noise)
    bodies = lambda data: [r["payload"] for r in read_records(data)]
    assert bodies(good) == bodies(gzip.compress(good)) == bodies(gzip.compress(record(b"one")) + gzip.compress(record(noise))) == [b"one", noise]
    assert bodies(gzip.compress(good)[:-100_000]) == bodies(gzip.compress(record(b"one")) + b"\x1f\x8bbroken") == [b"one"]
    assert bodies(gzip.compress(record(b"one")) + b"\x00" * 20) == [b"one"]
    assert bodies(record(b"one") + record(b"two")[:-8]) == [b"one"]
    assert bodies(record(b"one") + record(b"two", "²")) == bodies(record(b"one") + record(b"two", "9" * 30)) == [b"one"]
    assert [r["status"] for r in read_records(record(b"a", status="²") + record(b"b", status="20") + record(b"c"))] == [None, None, 200]
    assert bodies(b"") == bodies(b"\x1f\x8b") == bodies(b"WARC/" * 5) == []


def test_files_of_a_folder(spark, tmp_path):
    import gzip

    (tmp_path / "a.warc").write_bytes(record(b"plain"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(b"one")) + gzip.compress(record(b"two")))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record(b"three") * 2)[:-9])
    (tmp_path / "d.warc").write_bytes(b"")
    got = read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in got)[:2] == [b"one", b"plain"] and len({r.source_key for r in got}) == 3
    assert all(r.payload_bytes == len(r.payload) and r.status == 200 for r in got)


def test_empty_and_very_long_pages_with_clashing_columns(spark, tmp_path):
    rows = [(1, "http://a.com/x", "<title>a</title>" + LONG), (2, "http://a.com/x", ""), (3, "http://b.com/", MANY)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.withColumns({c: F.lit(c) for c in ("warc", "canonical", "ts", "chunk", "near", "hit", "headers", "c", "k")})
    clash.write.parquet(f"{tmp_path}/full/pages.parquet")
    clash.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    got = {r.page_id: (r.canonical, r.outcome, r.refers_to_page, r.payload_bytes) for r in queries.op4_warc_revisits(spark, f"{tmp_path}/full").collect()}
    assert got == {
        1: ("a.com/x", "validator_mismatch", None, None),  # page 2 was captured between
        2: ("a.com/x", "resolved", 2, 0),
        3: ("b.com", "resolved", 3, len(MANY)),
    }
    assert queries.op4_warc_revisits(spark, f"{tmp_path}/none").count() == 0


def test_awkward_pages(spark, tmp_path):
    rows = [(1, "http://a.com/", "<title>x</title>"), (1, "http://a.com/", "<title>x</title>"), (None, None, None), (2, None, "y"), (3, "http://a.com", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op4_warc_revisits(spark, str(tmp_path)).count() == 5
