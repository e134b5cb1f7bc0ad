"""Line dedup by a tree of line templates.

As in log parsing, a line falls to a leaf by its number of tokens and its ``DEPTH`` leading tokens, after tokens with a
digit have become ``<*>``. Within a leaf, variable fields are generalised: a template keeps ``PERCENT`` of a line's places, the
leading ones included, and every other place is ``<*>``. Only tokens that another line of the leaf has at the same place can be
kept. A line has two templates: one keeps the tokens that most lines have there, the other those that fewest others have (ties:
the earlier place), so that it meets a line with the same frame whether that frame is common in the leaf or not. A template
that keeps fewer than ``FRAME`` tokens beside the leading ones counts only if ``VALUES`` different lines have it: two short
lines that differ in a word are no evidence of a field. A line without a template is its own.

A template found in more than one document recurs: all but its first document lose its lines. The rule looks at counts alone,
so it needs no order of lines and no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, stage

DEPTH = 3
#: Share of a line's places that make its template, rounded up.
PERCENT = 70
#: Kept tokens beside the leading ones with which a template needs no further evidence, and different lines that it else needs.
FRAME, VALUES = 3, 4
#: Rows of a table of leaves or templates that is sent to all tasks, at most (about 100 MB); larger ones are shuffled.
SENT_ROWS = 500_000
#: A token with a digit; tried at the beginnings of tokens only, so that long ones cost no more than their length.
VARIABLE = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (names the document's row), i, leaf, h1 and h2 (name the masked line), masked of every line that has a token."""
    parted = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.split("text", "\n").alias("lines"))
    exploded = parted.select("doc_id", "row", F.posexplode("lines").alias("i", "line"))
    line = F.col("line")
    # few lines need a regular expression's replacement, so the rest is spared it
    uneven = reduce(Column.__or__, [F.contains(line, F.lit(gap)) for gap in ("  ", "\t", "\x0b", "\x0c", "\r")])
    spaced = F.btrim(F.when(uneven, F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")).otherwise(line))
    masked = F.when(F.col("s").rlike("[0-9]"), F.regexp_replace("s", VARIABLE, "<*>")).otherwise(F.col("s"))
    n_tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return (
        exploded.withColumn("s", spaced)
        .where("s <> ''")
        .withColumn("masked", masked)
        .select(
            "doc_id",
            "row",
            "i",
            F.xxhash64(n_tokens, F.substring_index("masked", " ", DEPTH)).alias("leaf"),
            F.xxhash64("masked").alias("h1"),
            F.xxhash64(F.lit(1), "masked").alias("h2"),
            "masked",
        )
    )


def _templates(lines: DataFrame) -> DataFrame:
    """h1, h2 and templates (their hashes t1 and t2) of the lines that have any; each distinct line is looked at once."""
    leaves = stage(lines.groupBy("leaf").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("leaf"), "leaves")
    distinct = lines.join(_sent(leaves), "leaf", "left_semi").groupBy("leaf", "h1", "h2").agg(F.first("masked").alias("masked"))
    words = F.split("masked", " ")
    lead = F.concat_ws(" ", F.size(words).cast("string"), F.slice(words, 1, DEPTH)).alias("lead")
    distinct = stage(distinct.select("leaf", "h1", "h2", lead, F.size(words).alias("n"), F.slice(words, DEPTH + 1, F.size(words)).alias("rest")), "distinct")
    tokens = distinct.select("leaf", "h1", "h2", F.posexplode("rest").alias("p", "token"))
    shared = tokens.groupBy("leaf", "p", "token").agg(F.count("*").alias("lines")).where("lines > 1")
    kept = tokens.join(shared, ["leaf", "p", "token"])
    few_first = kept.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("lines", "p", "token"))).alias("few_first"))
    joined = distinct.join(few_first, ["h1", "h2"], "left").select(
        "h1", "h2", "lead", F.greatest(F.floor((F.col("n") * PERCENT + 99) / 100).cast("int") - DEPTH, F.lit(0)).alias("kept"), F.coalesce("few_first", F.array()).alias("few_first")
    )
    many_first = F.sort_array(F.transform("few_first", lambda x: F.struct((-x["lines"]).alias("lines"), x["p"], x["token"])))

    def template(ranked: Column) -> Column:
        parts = F.sort_array(F.transform(F.slice(ranked, 1, F.col("kept")), lambda x: F.struct(x["p"], x["token"])))
        return F.struct(F.xxhash64("lead", parts).alias("t1"), F.xxhash64(F.lit(1), "lead", parts).alias("t2"))

    found = joined.where(F.size("few_first") >= F.col("kept")).select("h1", "h2", "kept", template(many_first).alias("many"), template(F.col("few_first")).alias("few"))
    found = stage(found, "found")
    loose = found.where(F.col("kept") < FRAME).select("h1", "h2", "many.t1", "many.t2")
    enough = loose.groupBy("t1", "t2").agg(F.count("*").alias("lines")).where(F.col("lines") >= VALUES)
    evident = loose.join(_sent(stage(enough.select("t1", "t2"), "enough")), ["t1", "t2"]).select("h1", "h2", F.array(F.struct("t1", "t2")).alias("templates"))
    framed = found.where(F.col("kept") >= FRAME).select("h1", "h2", F.array_distinct(F.array("many", "few")).alias("templates"))
    return stage(framed.unionByName(evident), "templates")


def recurring_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row and drops (indexes of lines to drop) of the documents that lose lines."""
    lines = stage(_lines(docs), "lines")
    found = lines.select("doc_id", "row", "i", "h1", "h2").join(_sent(_templates(lines)), ["h1", "h2"], "left")
    own = F.array(F.struct(F.col("h1").alias("t1"), F.col("h2").alias("t2")))
    named = found.select("doc_id", "row", "i", F.explode(F.coalesce("templates", own)).alias("t")).select("doc_id", "row", "i", "t.*")
    seen = named.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id <> last_id")
    lost = named.join(_sent(stage(seen, "seen")), ["t1", "t2"]).where("doc_id <> first_id or doc_id is null")
    drops = stage(lost.groupBy("doc_id", "row").agg(F.collect_set("i").alias("drops")), "drops")
    drop_staged(lines)
    return drops


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text without the lines dropped, n_lines, n_dropped.

    Lines are split at line feeds; those without tokens stay and never recur. The first document is the one of the
    smallest id; a null id is no document to recur in, and loses lines that recur in others. Rows with equal id keep the
    lines that only they have. A null text stays null with no lines; an empty table gives no rows; other columns aren't
    looked at.
    """
    part = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    lost = recurring_lines(part).withColumnRenamed("doc_id", "lost_id").withColumnRenamed("row", "lost_row")
    joined = part.withColumn("row", F.xxhash64("doc_id", "text")).join(
        lost, (F.col("row") == F.col("lost_row")) & F.col("doc_id").eqNullSafe(F.col("lost_id")), "left"
    )
    lines = F.split("text", "\n")
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drops", i)), "\n")
    )
    return joined.select(
        "doc_id",
        kept.alias("text"),
        F.coalesce(F.array_size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


