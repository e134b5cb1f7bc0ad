"""Quality rules: a table of thresholds compiled into one Spark projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words; as a regular expression's class and as the signs themselves.
GAP = "[\\x20\\x09-\\x0D]+"
GAP_SIGNS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the corpus' four languages.
STOP_WORDS = (
    "the of and to in is that for a be with it on was as "
    "le la les de des et en un que du est "
    "der die das und zu den von ein im mit "
    "el los las y por con para se"
).split()

#: name, ratio, least and greatest value allowed (None: no bound). Ratios of texts that pass the base rules.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    ("symbol_ratio", "n_symbols / word_chars", None, 0.10),
    ("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    ("upper_ratio", "n_upper / word_chars", None, 0.50),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.50),
    ("repeat_word_ratio", "n_repeat_words / n_words", None, 0.50),
]
MIN_WORDS = 50


def with_counts(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct of counts of each whole text, all by built-in functions; a null text has none of anything.

    Words of three-word windows are found by sorting the windows' hashes with their places: equal neighbours are repeats,
    and the windows' places, sorted, cover words without counting one twice. Work grows as n log n with a text's length.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(GAP_SIGNS))) > 0)
    bare = F.translate(text, GAP_SIGNS, "")
    step = docs.withColumn(
        name,
        F.struct(
            words.alias("words"),
            lines.alias("lines"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        ),
    )
    c = F.col(f"`{name}`")
    w = c["words"]
    n = F.size(w)
    windows = F.when(
        n >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
            )
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    step = step.withColumn(name, c.withField("windows", windows))
    s = c["windows"]
    repeats = F.sort_array(
        F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["p"]
        )
    )
    step = step.withColumn(name, c.withField("places", repeats).dropFields("windows"))
    p = c["places"]
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    stop = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))
    return step.withColumn(
        name,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size(c["lines"]).cast("long").alias("n_lines"),
            stop.cast("long").alias("n_stop_words"),
            c["n_upper"].alias("n_upper"),
        ),
    )


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def verdict(counts: Column, rules: list[tuple[str, str, float | None, float | None]] = RULES) -> Column:
    """The table of rules as one expression: true if every ratio is within its bounds. A ratio over nothing is 0."""
    fine = F.lit(True)
    for _, ratio, least, most in rules:
        over, under = (x.strip() for x in ratio.split("/"))
        value = F.coalesce(F.try_divide(counts[over].cast("double"), counts[under].cast("double")), F.lit(0.0))
        if least is not None:
            fine = fine & (value >= least)
        if most is not None:
            fine = fine & (value <= most)
    return fine


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and kept.

    Null and empty texts have no words and fail. Repeated rows are judged alike, other columns aren't looked at, and an
    empty table gives no rows. No shuffle.
    """
    part = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    c = F.col("c")
    failed = base_failed(c)
    return with_counts(part, "c").select("doc_id", "c.*", failed.alias("base_failed"), (~failed & verdict(c)).alias("kept"))
