"""License notices in texts: exact phrases, and fuzzy search of short notices with a bounded number of errors.

A notice with at most k errors, cut into k + 1 seeds, holds one seed without an error (pigeonhole). Exact seeds therefore
locate every candidate, and the regex library's bounded-error matching verifies it and counts its edits.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, pieces

#: Phrases that count as exact places, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices searched with errors, as words in lower case, and their labels.
NOTICES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "licensed under cc by nc": "cc-by-nc",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2",
    "bsd 3 clause license": "bsd-3-clause",
    "bsd 2 clause license": "bsd-2-clause",
    "licensed under cc by sa": "cc-by-sa",
    "eclipse public license": "epl",
}


def allowed_errors(notice: str) -> int:
    """One edit for a short notice, two from 30 letters on."""
    return 1 if len(notice) < 30 else 2


@cache
def _plans() -> list[tuple[bytes, str, list[tuple[bytes, int]], int, list[regex.Pattern]]]:
    plans = []
    for notice, label in NOTICES.items():
        k = allowed_errors(notice)
        data = notice.encode()
        cuts = [len(data) * i // (k + 1) for i in range(k + 2)]
        seeds = [(data[a:b], a) for a, b in zip(cuts, cuts[1:])]
        # the library puts no errors before a match, so letters before a notice's first are tried by a pattern of their own
        notice_with = lambda e: rb"(?:%s){e<=%d}" % (regex.escape(data, special_only=True), e)  # noqa: B023, E731
        begun = b"|".join(b"[^ ]{%d}" % n + notice_with(k - n) for n in range(1, k + 1))
        patterns = [regex.compile(rb"(?<![^ ])(?:%s)(?![^ ])" % p, regex.BESTMATCH) for p in (notice_with(k), begun)]
        plans.append((data, label, seeds, k, patterns))
    return plans


def edits(a: bytes, b: bytes) -> int:
    """The least number of letters put in, left out or changed between two short texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _name_kept(notice: bytes, found: bytes) -> bool:
    """Whether the words that tell one licence from another (numbers, and short names of up to three letters) are intact: an error there would be another licence."""
    names = {w for w in notice.split() if w.isdigit() or w in (b"cc", b"by", b"nc", b"sa", b"bsd", b"gnu")}
    return names <= set(found.split())


def fuzzy_notices(text: bytes) -> list[tuple[str, int, int, int]]:
    """Notices in a text of single-spaced words: (label, errors, first byte, end), each notice's overlaps once."""
    found = []
    for notice, label, seeds, k, patterns in _plans():
        spans: list[tuple[int, int]] = []
        for seed, offset in seeds:
            at = text.find(seed)
            while at >= 0:
                spans.append((max(0, at - offset - k), at - offset + len(notice) + k))
                at = text.find(seed, at + 1)
        done = -1
        for low, high in sorted(set(spans)):
            low = max(low, done)
            # one sign more on either side, so that word ends can be seen
            for pattern in patterns if low < high else ():
                m = pattern.search(text, low, min(len(text), high + 1))
                errors = edits(notice, m.group()) if m else k + 1
                if errors <= k and _name_kept(notice, m.group()):
                    found.append((label, errors, m.start(), m.end()))
                    done = m.end()
                    break
    return found


def scan(texts: list[bytes]) -> list[dict]:
    """What ``with_licenses`` reports of each text."""
    rows = []
    for text in texts:
        words = text.translate(ALNUM).split()
        joined = b" ".join(words)
        padded = b" " + joined + b" "
        places: list[int] = []
        labels = set()
        for phrase, label in BASE.items():
            wanted = b" " + phrase.encode() + b" "
            at = padded.find(wanted)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = padded.find(wanted, at + 1)
        gaps = np.flatnonzero(np.frombuffer(padded if places else b"", np.uint8) == 32)
        starts = sorted(np.searchsorted(gaps, places).tolist())
        fuzzy = fuzzy_notices(joined)
        score = 1.0 if places else max((1 - e / (b - a) for _, e, a, b in fuzzy), default=0.0)
        rows.append(
            {
                "n_words": len(words),
                "n_base": len(places),
                "first_word": starts[0] if starts else None,
                "last_word": starts[-1] if starts else None,
                "base_labels": ",".join(sorted(labels)),
                "labels": ",".join(sorted(labels | {x[0] for x in fuzzy})),
                "score": score,
                "spans": [
                    {"label": label, "errors": e, "first_word": joined.count(b" ", 0, a), "notice": joined[a:b].decode("utf-8", "replace")}
                    for label, e, a, b in fuzzy
                ],
            }
        )
    return rows


SPAN = pa.struct([("label", pa.string()), ("errors", pa.int64()), ("first_word", pa.int64()), ("notice", pa.string())])
FOUND = pa.struct(
    [
        *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(SPAN)),
    ]
)


FOUND_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,errors:bigint,first_word:bigint,notice:string>>"
)


def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([row for part in pieces(texts) for row in scan(part)], FOUND)


def with_licenses(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct of what each whole text says of licences; null and empty texts have no words and no labels.

    Words are runs of letters, digits and non-ASCII signs, A-Z lower-cased. n_base counts every place of a base phrase,
    first_word and last_word are the first and the last such place (null without one), base_labels their labels; labels
    also has those of notices found with errors; score is 1 for an exact phrase, else the best share of a notice without
    errors; spans lists the fuzzy matches. No shuffle; other columns untouched, whatever their names.
    """
    return docs.withColumn(name, F.arrow_udf(_scan, FOUND_DDL).asNondeterministic()(F.col(f"`{text_col}`").cast("binary")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the fields of ``with_licenses``."""
    part = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_licenses(part, "found").select("doc_id", "found.*")
