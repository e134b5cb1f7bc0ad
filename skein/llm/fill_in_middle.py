"""Fill-in-the-middle texts: a document's tokens are cut in two places and its parts put in another order.

The tokenizers library's Split pre-tokenizer, which is not trained, isolates the matches of ``TOKEN`` and gives their offsets
in code points: how many there are is n, and the offset at a rank is where a part ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or white space at the end.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 documents so many are changed, and of 100 of these so many have their suffix first.
CHANGED, SUFFIX_FIRST = 50, 80
#: Code points that the library takes apart at once; a longer text is cut between tokens.
RUN = 1 << 18

_BETWEEN = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


class Splitter:
    """Where the tokens of a text end, in code points."""

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(TOKEN), behavior="isolated").pre_tokenize_str

    def ends(self, text: str) -> np.ndarray:
        found = [np.empty(0, np.int64)]
        begin = 0
        while begin < len(text):
            cut = _BETWEEN.search(text, begin + RUN) if len(text) - begin > RUN else None
            end = cut.start() if cut else len(text)
            offsets = [stop for _, (_, stop) in self.split(text[begin:end])]
            found.append(np.array(offsets, np.int64) + begin)
            begin = end
        return np.concatenate(found)


_splitter: list[Splitter] = []


def _drawn(id_col: Column) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the hash of a document's id, as numbers; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_col.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with text, h1 and h2 to n and the code points before the middle and in it."""
    if not _splitter:
        _splitter.append(Splitter())
    for batch in batches:
        out = np.zeros((3, len(batch)), np.int64)
        for k, (text, h1, h2) in enumerate(zip(*(batch.column(c) for c in ("text", "h1", "h2")))):
            ends = _splitter[0].ends(text.as_py())
            n = len(ends)
            places = np.concatenate([[0], ends])
            first, second = sorted((h1.as_py() % (n + 1), h2.as_py() % (n + 1)))
            out[:, k] = n, places[first], places[second] - places[first]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, "n", "prefix_chars", "middle_chars"])


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output of every whole text, a row for each.

    The parts end after two drawn numbers of tokens, prefix first. psm writes prefix, suffix, middle, each after its mark; spm
    writes suffix, prefix, middle. Plain is the text itself with no lengths: where the draw says so, and texts that are empty
    or null, or contain a mark. Draws depend on the id alone, so rows of equal id and text have equal results. Other columns
    aren't looked at; an empty table gives no rows.
    """
    h1, h2, h3, h4 = _drawn(F.col(f"`{id_col}`"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= CHANGED), "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    part = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    cut = part.mapInArrow(_cuts, "doc_id long, text string, form string, h1 long, h2 long, n long, prefix_chars long, middle_chars long")
    begin, length = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix = F.concat(F.lit(PREFIX), F.substring("text", F.lit(1), begin))
    middle = F.concat(F.lit(MIDDLE), F.substring("text", begin + 1, length))
    suffix = F.concat(F.lit(SUFFIX), F.substring("text", begin + length + 1, F.char_length("text")))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
    changed = F.col("form") != "plain"
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.when(changed, F.col("prefix_chars")).alias("prefix_chars"),
        F.when(changed, F.col("middle_chars")).alias("middle_chars"),
        output.otherwise(F.concat(prefix, suffix, middle)).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: its parts lie between marks, which no changed text contains itself."""
    after = lambda mark: F.substring_index(output, mark, -1)  # noqa: E731  each mark stands once
    until = lambda part, mark: F.substring_index(part, mark, 1)
    return (
        F.when(form == "plain", output)
        .when(form == "spm", F.concat(until(after(PREFIX), MIDDLE), after(MIDDLE), until(after(SUFFIX), PREFIX)))
        .otherwise(F.concat(until(after(PREFIX), SUFFIX), after(MIDDLE), until(after(SUFFIX), MIDDLE)))
    )
