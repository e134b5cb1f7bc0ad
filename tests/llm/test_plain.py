"""Quality scores and licences against versions written row by row."""

import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import licenses, queries, quality_model

M64 = (1 << 64) - 1


# Quality


def spread(h):
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & M64
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & M64
    return h ^ (h >> 33)


def slots_of(text):
    words = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x09-\x0d\x20A-Za-z0-9\x80-\xff]+", (text or "").encode())
    hashes = [spread(xxhash.xxh64_intdigest(w)) for w in words]
    pairs = [1 if a == b else spread((x + xxhash.xxh64_intdigest(b)) & M64) & (quality_model.SIZE - 1) for a, b, x in zip(words, words[1:], hashes)]
    return [h & (quality_model.SIZE - 1) for h in hashes] + pairs


def shares(text, scale):
    found = slots_of(text)
    values = {}
    for s in found:
        values[s] = values.get(s, 0) + 1
    return {s: n * scale / max(1, len(found)) for s, n in values.items()}


class PlainFtrl:
    def __init__(self):
        self.z, self.n, self.bz, self.bn = {}, {}, 0.0, 0.0

    def weight(self, s):
        z = self.z.get(s, 0.0)
        if abs(z) <= quality_model.L1:
            return 0.0
        return (math.copysign(quality_model.L1, z) - z) / ((quality_model.BETA + math.sqrt(self.n.get(s, 0.0))) / quality_model.ALPHA + quality_model.L2)

    def bias(self):
        return -self.bz * quality_model.ALPHA / (quality_model.BETA + math.sqrt(self.bn))

    def probability(self, values):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(self.weight(s) * v for s, v in values.items()) + self.bias()))))

    def learn(self, values, label):
        g, b = self.probability(values) - label, self.bias()
        for s, v in values.items():
            w, n = self.weight(s), self.n.get(s, 0.0)
            self.z[s] = self.z.get(s, 0.0) + g * v - (math.sqrt(n + (g * v) ** 2) - math.sqrt(n)) / quality_model.ALPHA * w
            self.n[s] = n + (g * v) ** 2
        self.bz += g - (math.sqrt(self.bn + g * g) - math.sqrt(self.bn)) / quality_model.ALPHA * b
        self.bn += g * g


def test_scores_of_the_small_table_against_a_plain_model(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    marked = spark.read.parquet(f"{small}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id")).collect()
    model = PlainFtrl()
    for _ in range(quality_model.EPOCHS):
        for r in rows:
            if r.doc_id in texts:
                model.learn(shares(texts[r.doc_id], quality_model.SCALE), r.y)
    got = queries.op2_quality_model(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(model.probability(shares(texts[r.doc_id], quality_model.SCALE)), abs=2e-4), r
        assert r.predicted == (r.score >= 0.3)


# Licences


def plain_notices(text):
    """Labels of notices that some run of whole words is within the allowed edits of, its telling words intact."""
    words, found = text.split(), set()
    for notice, label in licenses.NOTICES.items():
        k, n = licenses.allowed_errors(notice), len(notice.split())
        telling = {w for w in notice.split() if w.isdigit() or w in ("cc", "by", "nc", "sa", "bsd", "gnu")}
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + n + k) + 1):
                run = " ".join(words[i:j])
                if abs(len(run) - len(notice)) <= k and telling <= set(words[i:j]) and licenses.edits(notice.encode(), run.encode()) <= k:
                    found.add(label)
    return found


def test_edit_distance():
    for a, b, want in (("", "", 0), ("abc", "", 3), ("abc", "abc", 0), ("abc", "xabc", 1), ("abc", "acx", 2), ("kitten", "sitting", 3)):
        assert licenses.edits(a.encode(), b.encode()) == licenses.edits(b.encode(), a.encode()) == want


def test_random_edits_against_every_run_of_words():
    rnd, missed, extra, n_found = random.Random(6), [], [], 0
    for _ in range(2500):
        notice = rnd.choice(sorted(licenses.NOTICES))
        letters = list(notice)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(letters) + 1)
            how = rnd.randrange(3)
            if how == 0:
                letters.insert(at, rnd.choice("qze "))
            elif letters and at < len(letters):
                letters[at : at + 1] = [] if how == 1 else [rnd.choice("qze")]
        text = " ".join(f"some words {''.join(letters)} {rnd.choice(['here', 'v', ''])}".split())
        got, want = {x[0] for x in licenses.fuzzy_notices(text.encode())}, plain_notices(text)
        n_found += len(want)
        missed += [(text, want - got)] * (not want <= got)
        extra += [(text, got - want)] * (not got <= want)
    assert not extra and n_found > 800, extra[:3]
    assert not missed, (len(missed), missed[:5])


@pytest.mark.parametrize("text,label", [("qlicensed under cc by sa", "cc-by-sa"), ("zapache license version 2", "apache-2"), ("xgnu general public license version 3", None)])
def test_a_letter_before_the_first(text, label):
    assert {x[0] for x in licenses.fuzzy_notices(f"a {text} b".encode())} == ({label} if label else set())
