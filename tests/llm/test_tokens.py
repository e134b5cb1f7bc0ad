"""Byte-level BPE, fill-in-the-middle and alignment against the libraries and plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import queries
from skein.llm.alignment import PAIR, _aligner, align, align_tokens, with_corpus_counts
from skein.llm.byte_bpe import Ranks, _encoder, decode_ids, encode_texts, replay_merges
from skein.llm.fill_in_middle import TOKEN, Splitter, fill_in_middle, restored

RANKS = public_tokenizers.path(queries.RANKS)
ODD = "aB'sçÉ .,!12\n\t  \x1c\x85　İ<|endoftext|><s><P>日本\U0001f600"
TEXTS = st.text(max_size=60) | st.text(ODD, max_size=60)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def tiktokens():
    import tiktoken

    encoder = _encoder(RANKS, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    texts = [None, "", " ", "\n", "word", " a  b\n\nc ", "x" * 30_000, "one two " * 20_000, "<P> in it", "a <|endoftext|> b <s>", "ﬁ ligature", "▁ block", "á \x00 b"]
    texts += ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(50))) for _ in range(100)]
    rows = [(k if k else None, t, 1) for k, t in enumerate([*texts, *texts[:30]])] + [(7, "word", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnsRenamed({}).selectExpr("*", "1 AS n", "2 AS row", "3 AS pairs", "4 AS form", "5 AS h1")


# Byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_ids_are_the_librarys(tiktokens, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    texts = ["".join(c for c in t if not unassigned(c)) for t in texts]
    got = [np.frombuffer(x, "<u4").tolist() for x in _encoder(RANKS, public_tokenizers.PATTERN).encode(texts)]
    assert got == [tiktokens(t) for t in texts]


def unassigned(c):
    import unicodedata

    return unicodedata.category(c) == "Cn"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=14), max_size=12, unique=True), st.randoms(use_true_random=False))
def test_replay_is_the_plain_rule_whatever_the_ranks(words, rnd):
    """Also for ranks that no training gives: a token that goes before its parts, two ways to the same token."""
    tokens = list({"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 5))) for _ in range(25)})
    rnd.shuffle(tokens)
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + k for k, t in enumerate(tokens)}

    def plain(word):
        parts = [bytes([b]) for b in word]
        while word not in ranks:
            pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            _, k = min(pairs)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[word]] if word in ranks else [ranks[p] for p in parts]

    words = [w.encode() for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in replay_merges(words, Ranks(ranks))] == [plain(w) for w in words]


def test_a_full_memory_changes_nothing(tiktokens, monkeypatch):
    from skein.llm import units
    from skein.llm.byte_bpe import ByteEncoder

    monkeypatch.setattr(units, "KNOWN", 20)
    encoder, rnd = ByteEncoder(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(30):
        texts = [" ".join(rnd.choice(["ab", "cd,", "word", "other", "w" * 70, str(rnd.randrange(99))]) for _ in range(20)) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [tiktokens(t) for t in texts]


def test_new_words_are_cut_and_gathered_on_arrays(tiktokens):
    """Words that were never met cost no Python calls of their own (op11's CPU seconds on texts of many rare words)."""
    import sys

    from skein.llm.byte_bpe import ByteEncoder

    encoder, rnd = ByteEncoder(RANKS, public_tokenizers.PATTERN), random.Random(7)
    texts = [" ".join("".join(rnd.choice("aeinrstÉß,'7") for _ in range(5)) for _ in range(500)) for _ in range(400)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = list(encoder.encode(texts))
    finally:
        sys.setprofile(None)
    assert calls < 200_000  # without those for each rank that stands anywhere, of which there are at most as many as tokens
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tiktokens(t) for t in texts]


def test_other_patterns_and_unknown_ids(spark, tiktokens):
    from skein.llm.byte_bpe import ByteEncoder

    other = ByteEncoder(RANKS, r"\S+|\s+")
    assert b"".join(other.encode(["ab  cd", "", "é"])) == np.array([k for w in ("ab", "  ", "cd", "é") for k in other_ids(other, w)], "<u4").tobytes()
    rows = spark.createDataFrame([(1, None), (2, [64, 65]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: len(r.data) for r in decode_ids(rows, RANKS).collect()} == {1: 0, 2: 2, 3: 0}
    with pytest.raises(Exception, match="no token"):
        decode_ids(spark.createDataFrame([(1, [10**8])], "doc_id long, ids array<int>"), RANKS).collect()


def other_ids(encoder, word):
    (ids,) = replay_merges([word.encode()], encoder.vocabulary)
    return np.frombuffer(ids, "<u4").tolist()


def test_encoding_of_awkward_rows(spark, docs, tiktokens):
    encoded = encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    want = Counter((r.doc_id, tuple(tiktokens(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.data)) for r in decode_ids(encoded, RANKS).collect()) == want
    assert encode_texts(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_of_byte_bpe(spark, small, tiktokens):
    want = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = tiktokens(r.text or "")
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(r.text or "")))
    assert {tuple(r) for r in queries.op11_byte_bpe(spark, small).collect()} == want


# Fill in the middle


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ends_are_the_patterns(text):
    text = text.encode("utf-8", "ignore").decode()
    assert Splitter().ends(text).tolist() == [m.end() for m in re.finditer(TOKEN, text)]


def test_long_texts_are_cut_between_tokens(monkeypatch):
    from skein.llm import fill_in_middle as module

    monkeypatch.setattr(module, "RUN", 7)
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice("ab \né\t") for _ in range(rnd.randrange(80)))
        assert Splitter().ends(text).tolist() == [m.end() for m in re.finditer(TOKEN, text)]


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(TOKEN, text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_awkward_rows(spark, docs):
    made = fill_in_middle(docs)
    rows = made.withColumn("text", restored(made["output"], made["form"])).collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(plain_fim(r.doc_id, r.text) for r in docs.collect())
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert len({r.form for r in rows}) == 3 and fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_agrees_with_sql(spark, oracle, small):
    got = queries.op12_fill_in_middle(spark, small)
    result = oracle.execute(queries.OP12_SQL)
    assert [x[0] for x in result.description] == got.columns
    assert {tuple(r) for r in got.collect()} == set(result.fetchall())


# Alignment


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, unique=True), st.lists(st.integers(1, 30), min_size=1, unique=True))
def test_links_and_groups_against_all_pairs(a, b):
    a, b = sorted({*a, 31}), sorted({*b, 31})
    x, y = list(zip([0, *a], a)), list(zip([0, *b], b))
    i, j, groups = (found.tolist() for found in align(np.array(a), np.array(b)))
    assert list(zip(i, j)) == [(i, j) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if max(s, t) < min(e, f)]
    assert groups == [a.index(e) for e in sorted({*a} & {*b})]


def plain_alignment(rows):
    """Each text as a whole through the libraries; bytes compared one by one."""
    aligner = _aligner(*map(public_tokenizers.path, queries.ALIGNED))
    counts, out = Counter(), []
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        a = aligner.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = aligner.b.encode(text or "")
        a_bytes, b_bytes = [aligner.a_bytes[k] for k in a], [aligner.b_bytes[k] for k in b]
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            out.append((doc_id, [], [], [], ""))
            continue
        at_a = [k for k, t in enumerate(a_bytes) for _ in t]
        at_b = [k for k, t in enumerate(b_bytes) for _ in t]
        links = sorted(set(zip(at_a, at_b)))
        cuts = [k + 1 for k in range(len(data)) if k + 1 == len(data) or at_a[k] != at_a[k + 1] and at_b[k] != at_b[k + 1]]
        groups, begin = [], 0
        for cut in cuts:
            groups.append(",".join(str(a[k]) for k in sorted(set(at_a[begin:cut]))) + "|" + ",".join(str(b[k]) for k in sorted(set(at_b[begin:cut]))))
            begin = cut
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        out.append((doc_id, a, b, pairs, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter(
        (i, len(a), len(b), g.count(";") + 1 if g else 0, len(p), g, sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p)) for i, a, b, p, g in out
    )


def whole(aligner, text):
    """Values of a text that the libraries are given as a whole."""
    data = (" " + text).encode()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    same = text and b"".join(aligner.a_bytes[k] for k in a) == data == b"".join(aligner.b_bytes[k] for k in b)
    return [a, b] if same else [[], []]


def sides(values):
    return [(values[values % 2 == k] >> 1).tolist() for k in (0, 1)]


def test_new_units_are_coded_and_aligned_on_arrays():
    """A unit that was never met costs some calls, not dozens (op13's CPU seconds on texts of many rare words)."""
    import sys

    from skein.llm.alignment import Aligner

    aligner, rnd = Aligner(*map(public_tokenizers.path, queries.ALIGNED)), random.Random(8)
    texts = [" ".join("".join(rnd.choice("aeinrstÉß'") for _ in range(8)) + rnd.choice(["", ",", "...", "###"]) for _ in range(500)) for _ in range(40)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = aligner.coded(texts)
        aligner.rows(found)
    finally:
        sys.setprofile(None)
    assert calls < 8 * 20_000
    assert [sides(v) for v in found] == [whole(aligner, t) for t in texts]


def test_last_signs_of_units_and_a_full_memory_change_nothing():
    from skein.llm.alignment import Aligner

    aligner, rnd = Aligner(*map(public_tokenizers.path, queries.ALIGNED)), random.Random(9)
    assert aligner.apart and aligner.signs_apart
    aligner.known.most = 40
    parts = ["ab", "É", "ü", "×", "…", "12", ",", "'", "'s", "...", "###", "l'", "|", " ", " ", " ", "\n", "\t", "\u3000", "日", "ﬁ", "<s>", "</s>", "<0x0A>", "▁", "\x1c"]
    for _ in range(300):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(1, 6))]
        assert [sides(v) for v in aligner.coded(texts)] == [whole(aligner, t) for t in texts]


@pytest.mark.parametrize("sent", [0, 40, 10**6])
def test_alignment_of_awkward_rows(spark, docs, sent):
    files = list(map(public_tokenizers.path, queries.ALIGNED))
    aligned = align_tokens(docs, *files)
    got = with_corpus_counts(aligned, sent)
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert Counter(tuple(r) for r in got.select(order).collect()) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    assert all(p < PAIR * 60_000 for r in aligned.collect() for p in r.pairs)
    assert with_corpus_counts(align_tokens(docs.limit(0), *files)).count() == 0


def test_query_of_alignment(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = Counter((*r[:5], sha(r[5]) if r[5] else "", *r[6:]) for r in plain_alignment(rows).elements())
    got = queries.op13_alignment(spark, small)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(tuple(r) for r in got.collect()) == want
