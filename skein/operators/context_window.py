"""What a model sees of a thread: running size, newest messages, summary of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import checkpointed
from .scan import CUT_ROWS, with_cuts


def token_estimate(text: Column) -> Column:
    """Tokens of a text, taken as a quarter of its characters, rounded up: an approximation."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def running_size(messages: DataFrame) -> DataFrame:
    """Characters of the thread up to and with each message."""
    w = Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("running_chars", F.sum(F.length(F.coalesce("content", F.lit("")))).over(w))


def keep_last(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each thread."""
    r = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("seq")))
    return messages.withColumn("from_end", r).where(F.col("from_end") <= n).drop("from_end")


def summary_trigger(messages: DataFrame, most_tokens: int = 100) -> DataFrame:
    """Per thread: n_messages, tokens, and whether a summary is due (more than ``most_tokens``)."""
    return (
        messages.groupBy("thread_id")
        .agg(F.count("*").alias("n_messages"), F.sum(token_estimate(F.col("content"))).alias("tokens"))
        .withColumn("is_due", F.col("tokens") > most_tokens)
    )


def summarise(messages: DataFrame, most_tokens: int = 100, keep: int = 1, chars: int = 80) -> DataFrame:
    """Threads over the limit become one summary message, placed first, and their newest ``keep`` messages.

    The summary stands in for a model's: the first ``chars`` characters of each older message, joined by a space.
    """
    w = Window.partitionBy("thread_id")
    marked = (
        messages.select("thread_id", "seq", "role", "content")
        .withColumn("tokens", F.sum(token_estimate(F.col("content"))).over(w))
        .withColumn("from_end", F.row_number().over(w.orderBy(F.desc("seq"))))
        .withColumn("is_old", (F.col("tokens") > most_tokens) & (F.col("from_end") > keep))
    )
    parts = F.sort_array(F.collect_list(F.struct("seq", F.left(F.coalesce("content", F.lit("")), F.lit(chars)).alias("t"))))
    summaries = (
        marked.where("is_old")
        .groupBy("thread_id")
        .agg(F.lit(-1).cast("long").alias("seq"), F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("content"))
        .select("thread_id", "seq", F.lit("summary").alias("role"), "content")
    )
    rest = marked.where("not is_old").select("thread_id", "seq", "role", "content")
    both = summaries.unionByName(rest)
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("seq")).cast("long") - 1
    return both.select("thread_id", place.alias("place"), "role", "content")


def is_new_reply(messages: DataFrame) -> DataFrame:
    """Messages at which the thread grew and the newest is from the model."""
    w = Window.partitionBy("thread_id").orderBy("seq")
    return messages.withColumn("is_new_reply", (F.col("role") == "ai") & F.coalesce(F.col("seq") > F.lag("seq").over(w), F.lit(True)))


def _passed(tokens, most: int):
    """Of messages in order: running tokens, those before each, and the place after the one with which a round from each passes ``most``."""
    import numpy as np

    so_far = np.cumsum(tokens)
    before = so_far - tokens
    return so_far, before, np.searchsorted(so_far, before + most, "right") + 1


def _through(tokens, most: int):
    """What becomes of a round that comes into a run of messages: rows of least, leaves, adds and begins.

    A row holds for a round that comes with ``least`` tokens up to the next row's; -1 stands for none, so that the first message
    begins one. It leaves with ``leaves`` tokens (-1: none), or if that is null with as many more as ``adds``, and ``begins``
    rounds begin within. Each possible beginning is followed to its end by pointer doubling.
    """
    import numpy as np

    so_far, before, to = _passed(tokens, most)
    n, place = len(tokens), np.arange(len(tokens))
    inside = to < n
    jump, begins = np.where(inside, to, place), inside.astype("int64")
    while True:
        begins = begins + begins[jump]
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    leaves, begins = np.where(to[jump] == n, -1, so_far[-1] - before[jump]), begins + 1
    ends = np.flatnonzero((tokens > 0) & (before <= most))[::-1]  # where the round that comes in may pass the limit
    rows = [(-1, int(leaves[0]), 0, int(begins[0]))]
    if so_far[-1] <= most:
        rows.append((0, None, int(so_far[-1]), 0))
    for end in ends:
        least, last = max(int(most - so_far[end]) + 1, 0), end + 1 == n
        rows.append((least, -1 if last else int(leaves[end + 1]), 0, 0 if last else int(begins[end + 1])))
    return rows


def _with_first(table, rows, names: list[str], keys: list[str]):
    """An Arrow table of ``rows`` of longs behind the keys of a group's table."""
    import pyarrow as pa

    values = [pa.array(v, pa.int64()) for v in (zip(*rows) if rows else [[]] * len(names))]
    first = pa.array([0] * len(rows), pa.int64())
    return pa.table([*[table.column(k).take(first) for k in keys], *values], names=[*keys, *names])


def _enters(cut: DataFrame, most: int) -> DataFrame:
    """thread_id, cut, enters (tokens of the round that comes in, -1: none) and rounds (begun before) of the cuts of large threads."""
    import numpy as np

    large = checkpointed(cut.where("__cut > 0").select(F.col("thread_id").alias("__t")).distinct())
    rows = cut.join(F.broadcast(large), F.col("thread_id").eqNullSafe(F.col("__t")), "left_semi").select("thread_id", F.col("__cut").cast("long").alias("cut"), "seq", "tokens")

    def through(table):
        ordered = table.sort_by("seq")
        return _with_first(table, _through(ordered.column("tokens").to_numpy(), most), ["least", "leaves", "adds", "begins"], ["thread_id", "cut"])

    def follow(table):
        table = table.sort_by([("cut", "ascending"), ("least", "ascending")])
        cuts, least, adds, begins = (table.column(c).to_numpy() for c in ("cut", "least", "adds", "begins"))
        leaves = table.column("leaves")
        firsts = np.flatnonzero(np.diff(cuts, prepend=-1))
        tokens, rounds, out = -1, 0, []
        for k, (low, high) in enumerate(zip(firsts, [*firsts[1:], len(cuts)])):
            out.append((int(cuts[low]), tokens, rounds))
            at = int(low + np.searchsorted(least[low:high], tokens, "right") - 1)
            left = leaves[at].as_py()
            tokens, rounds = int(tokens + adds[at]) if left is None else left, int(rounds + begins[at])
        return _with_first(table, out, ["cut", "enters", "rounds"], ["thread_id"])

    kind = StructType([rows.schema["thread_id"]])
    passages = rows.groupBy("thread_id", "cut").applyInArrow(through, _longs(kind, ["cut", "least", "leaves", "adds", "begins"]))
    return checkpointed(passages.groupBy("thread_id").applyInArrow(follow, _longs(kind, ["cut", "enters", "rounds"])))


def _longs(kind: StructType, names: list[str]) -> StructType:
    return StructType([*kind.fields, *[StructField(n, LongType()) for n in names]])


def _marked(batches, most: int):
    """Rounds of Arrow batches in order of thread_id, cut and seq; what a batch ends with is carried on to the next."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        thread = batch.column("thread_id")
        tokens, cuts, enters, rounds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "cut", "enters", "rounds"))
        n = len(tokens)
        threads = pa.concat_arrays([last[0] if last else thread.slice(0, 1), thread])
        one, two = threads.slice(0, n), threads.slice(1)
        same = pc.fill_null(pc.equal(one, two), False).to_numpy(zero_copy_only=False) | (pc.is_null(one).to_numpy(zero_copy_only=False) & pc.is_null(two).to_numpy(zero_copy_only=False))
        new = ~same | (np.diff(cuts, prepend=last[1] if last else -1) != 0)
        goes_on = not new[0]
        new[0] = True
        starts = np.flatnonzero(new)
        lengths = np.diff(starts, append=n)
        come, begun = enters[starts].copy(), rounds[starts].copy()
        if goes_on:
            come[0], begun[0] = last[2:]
        so_far, before, to = _passed(tokens, most)
        ends = np.repeat(starts + lengths, lengths)
        jump = np.append(np.where(to < ends, to, n), n)
        first = np.where(come < 0, starts, np.searchsorted(so_far, before[starts] + most - np.maximum(come, 0), "right") + 1)
        begins = np.zeros(n + 1, bool)
        begins[first[first < starts + lengths]] = True
        while (jump < n).any():
            begins[jump[np.flatnonzero(begins)]] = True
            jump = jump[jump]
        begins = begins[:n]
        start = np.repeat(starts, lengths)
        number = np.cumsum(begins)
        round_no = np.repeat(begun, lengths) + number - (number - begins)[start]
        latest = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        size = np.where(latest >= start, so_far - before[latest], np.repeat(come, lengths) + so_far - before[start])
        due = size > most
        last = thread.slice(n - 1, 1), cuts[-1], -1 if due[-1] else size[-1], round_no[-1]
        values = [thread, batch.column("seq"), batch.column("tokens"), pa.array(round_no), pa.array(size), pa.array(due)]
        yield pa.RecordBatch.from_arrays(values, names=["thread_id", "seq", "tokens", "round", "round_tokens", "is_due"])


def summary_rounds(messages: DataFrame, most_tokens: int = 100, cut_rows: int = CUT_ROWS) -> DataFrame:
    """thread_id, seq, tokens, round (from 1), round_tokens (so far in the round) and is_due of each message of a thread.

    A summary is due at the message with which a round's tokens pass ``most_tokens``; the next round begins after it. ``seq`` is
    unique in its thread. Rounds aren't found row by row: a search in the running tokens finds where each possible round ends,
    pointer doubling which rounds there are. A long thread is cut: for each cut it is found what becomes of any round that
    comes in, of which there are as many kinds as messages that a round can hold at most; these are put together over the cuts of
    a thread (scan.GRID at most), and then all cuts are marked at once. The number of jobs doesn't depend on the threads' length.
    """
    sized = checkpointed(messages.select("thread_id", "seq", token_estimate(F.col("content")).alias("tokens")))
    rows, some = with_cuts(sized, ["thread_id"], "seq", cut_rows)
    enters, rounds = F.lit(-1).cast("long"), F.lit(0).cast("long")
    if some:
        comes = _enters(rows, most_tokens).select(F.col("thread_id").alias("__t"), F.col("cut").alias("__c"), "enters", "rounds")
        rows = rows.join(F.broadcast(comes), F.col("thread_id").eqNullSafe(F.col("__t")) & (F.col("__cut") == F.col("__c")), "left")
        enters, rounds = F.coalesce("enters", enters), F.coalesce("rounds", rounds)
    asked = rows.select("thread_id", "seq", "tokens", F.col("__cut").cast("long").alias("cut"), enters.alias("enters"), rounds.alias("rounds"))
    ordered = asked.repartition("thread_id", "cut").sortWithinPartitions("thread_id", "cut", "seq")
    kind = _longs(StructType([sized.schema["thread_id"], sized.schema["seq"]]), ["tokens", "round", "round_tokens"]).add("is_due", "boolean")
    return ordered.mapInArrow(lambda batches: _marked(batches, most_tokens), kind)
