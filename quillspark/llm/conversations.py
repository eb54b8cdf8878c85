"""Conversations from message rows.

``sessionized`` is for messages with times: rows of a channel are put in order,
a session ends where nothing follows within a gap that is calibrated on the gaps
of all channels, the one who begins a session is its user, and sessions without
replies are dropped.

``conversations`` is for events that carry their session and number.  Rows are put into sessions by their channel (``session_id``) and ordered by
``seq``, the clock of a session; the calibrated inactivity gap is one step of
it, since a session numbers its events without gaps.  Roles follow from the
event types, and sessions without reciprocal replies, with gaps, clashes or
unreadable rows are dropped.

Skew: every step is an aggregation with a map-side part, or a window over a
block of ``BLOCK`` sequence numbers of one session, whose ends are compared in a
second, much smaller window.  No task needs all rows of a session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = 10_000
#: Event types that carry messages, and their roles.
ROLES = {"turn_start": "user", "answer": "assistant"}


def visible(text: Column) -> Column:
    """Some character that is neither white space nor a control or format character."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"), F.lit(False))


def events(rows: DataFrame) -> DataFrame:
    """(session_id, seq, kind, text, value) of each distinct event; ``kind`` is null where it can't be read."""
    doc = F.try_parse_json(F.col("payload"))
    opened = F.when(F.schema_of_variant(doc) == "STRING", F.try_parse_json(F.try_variant_get(doc, "$", "string"))).otherwise(doc)
    parsed = rows.where(F.col("session_id").isNotNull()).select("session_id", F.col("seq").cast("long").alias("seq"), opened.alias("doc"))
    kind = F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.try_variant_get("doc", "$.type", "string"))
    return parsed.select(
        "session_id",
        F.coalesce("seq", F.try_variant_get("doc", "$.seq", "long")).alias("seq"),
        kind.alias("kind"),
        F.when(kind.isin(*ROLES), F.try_variant_get("doc", "$.text", "string")).alias("text"),
        F.unhex(F.md5(F.to_json("doc"))).alias("value"),  # a VARIANT's keys are sorted: equal values, equal text
    )


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each session and number: equal copies merged, clashes marked."""
    return events(rows).groupBy("session_id", "seq").agg(
        (F.min("value") != F.max("value")).alias("clash"),
        F.max(F.col("kind").isNull() | F.col("seq").isNull()).alias("unreadable"),
        F.first("kind", ignorenulls=True).alias("kind"),
        F.first("text", ignorenulls=True).alias("text"),
    )


def _markers(merged: DataFrame) -> DataFrame:
    """The starts and the visible answers of each session, in blocks."""
    start = F.col("kind") == "turn_start"
    return merged.where(start | ((F.col("kind") == "answer") & visible(F.col("text")))).select(
        "session_id", "seq", F.floor(F.col("seq") / BLOCK).alias("block"), start.alias("start"), "text"
    )


def _unanswered(markers: DataFrame) -> DataFrame:
    """Sessions in which a start is followed by another start or by nothing."""
    inside = Window.partitionBy("session_id", "block").orderBy("seq")
    blocks = markers.withColumn("next", F.lead("start").over(inside)).groupBy("session_id", "block").agg(
        F.max(F.col("start") & F.coalesce("next", F.lit(False))).alias("bad"),
        F.min_by("start", "seq").alias("first"),
        F.max_by("start", "seq").alias("last"),
    )
    across = Window.partitionBy("session_id").orderBy("block")
    after = F.coalesce(F.lead("first").over(across), F.lit(True))  # the end counts like a new start
    return blocks.withColumn("bad", F.col("bad") | (F.col("last") & after)).groupBy("session_id").agg(F.max("bad").alias("unanswered"))


def judged(rows: DataFrame) -> DataFrame:
    """(session_id, dropped, reason) of every session; the reason is the first of the listed ones that holds."""
    merged = _merged(rows)
    start, answer = F.col("kind") == "turn_start", F.col("kind") == "answer"
    whole = merged.groupBy("session_id").agg(
        F.max("unreadable").alias("unreadable"),
        F.max(F.coalesce("clash", F.lit(False))).alias("clash"),
        F.count(F.when(F.col("seq") >= 1, 1)).alias("numbers"),
        F.max("seq").alias("largest"),
        F.count(F.when(start, 1)).alias("starts"),
        F.count(F.when(start & ~visible(F.col("text")), 1)).alias("blank_starts"),
        F.min(F.when(start, F.col("seq"))).alias("first_start"),
        F.min(F.when(answer, F.col("seq"))).alias("first_answer"),
    )
    checked = whole.join(_unanswered(_markers(merged)), "session_id", "left")
    reason = (
        F.when(F.col("unreadable"), "unreadable")
        .when(F.col("clash"), "clash")
        .when(F.col("largest").isNull() | (F.col("numbers") != F.col("largest")), "gap")
        .when((F.col("starts") == 0) | (F.col("blank_starts") > 0), "no question")
        .when(F.col("first_answer") < F.col("first_start"), "answer first")
        .when(F.coalesce("unanswered", F.lit(True)), "unanswered")
    )
    return checked.select("session_id", reason.isNotNull().alias("dropped"), reason.alias("reason"))


def conversations(rows: DataFrame) -> DataFrame:
    """(session_id, message_no, seq, role, text) of the sessions that stay, numbered from 1 in order of seq.

    Rows with a null session belong to none.  A null seq stands in the payload;
    where it does not, the session is unreadable.  Answers without visible text
    are left out.  Repeated rows count once, empty tables give an empty result,
    and other columns are ignored.
    """
    merged = _merged(rows)
    markers = _markers(merged).join(judged(rows).where(~F.col("dropped")), "session_id", "left_semi")
    inside = Window.partitionBy("session_id", "block").orderBy("seq")
    sizes = markers.groupBy("session_id", "block").agg(F.count("*").alias("size"))
    across = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("session_id", "block", F.coalesce(F.sum("size").over(across), F.lit(0)).alias("before"))
    numbered = markers.withColumn("place", F.row_number().over(inside)).join(before, ["session_id", "block"])
    return numbered.select(
        "session_id", (F.col("before") + F.col("place")).alias("message_no"), "seq",
        F.when(F.col("start"), ROLES["turn_start"]).otherwise(ROLES["answer"]).alias("role"), "text",
    )


#: Seconds of a channel that one window takes; what lies between two of them is compared by their ends.
STRETCH = 86_400
SECOND = 1_000_000
#: Steps of the histogram of gaps to each doubling.
FINE = 4


def _tick() -> Column:
    return F.floor(F.col("us") / (STRETCH * SECOND))


def gaps(rows: DataFrame) -> DataFrame:
    """Messages (channel, us, tie, ...) with ``gap``, the microseconds since the message before in their channel, null for the first.

    No window takes more than a day of a channel; days are compared by their last times.
    """
    ticked = rows.withColumn("tick", _tick())
    inside = Window.partitionBy("channel", "tick").orderBy("us", "tie")
    across = Window.partitionBy("channel").orderBy("tick")  # a row for each day
    ends = ticked.groupBy("channel", "tick").agg(F.max("us").alias("last")).withColumn("before", F.lag("last").over(across)).drop("last")
    return ticked.join(ends, ["channel", "tick"]).withColumn("gap", F.col("us") - F.coalesce(F.lag("us").over(inside), "before")).drop("before")


def calibrated_gap(spaced: DataFrame) -> float:
    """The gap (microseconds) that separates sessions: where the histogram of the gaps' logarithms falls best into two parts (Otsu's criterion).

    The histogram has some 260 rows at most. Gaps under a second count as one. With fewer than two different ones nothing is separated.
    """
    found = spaced.where("gap is not null").groupBy(F.floor(FINE * F.log2(F.greatest("gap", F.lit(SECOND)))).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    bins, counts = [r["bin"] for r in found], [r["n"] for r in found]
    total, whole = sum(counts), sum(b * n for b, n in zip(bins, counts))
    best, cut_at, n, weight = -1.0, math.inf, 0, 0
    for b, k, following in zip(bins, counts, bins[1:]):
        n, weight = n + k, weight + b * k
        spread = n * (total - n) * (weight / n - (whole - weight) / (total - n)) ** 2
        if spread > best:
            best, cut_at = spread, 2.0 ** ((b + 1 + following) / 2 / FINE)
    return cut_at


def sessionized(messages: DataFrame, channel: str, at: str, speaker: str, text: str, gap: float | None = None) -> DataFrame:
    """(channel, session_no, message_no, at, role, text) of the sessions that have replies.

    ``gap`` in microseconds, calibrated where it isn't given.  Messages at the
    same time are ordered by their content.  The speaker of a session's first
    message is its user, all others are assistants.  A session is dropped if no
    assistant speaks in it or if its last message with visible text isn't an
    assistant's; messages without visible text are left out.  Rows with a null
    channel or time belong to none; a null speaker is a speaker of its own.
    Repeated rows count once.
    """
    rows = messages.select(
        F.col(channel).alias("channel"), F.col(at).alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.coalesce(F.col(speaker).cast("string"), F.lit("")).alias("speaker"), F.col(text).alias("text")
    ).where(F.col("channel").isNotNull() & F.col("us").isNotNull() & visible(F.col("text"))).distinct()
    spaced = gaps(rows.withColumn("tie", F.struct("speaker", "text")))
    if gap is None:
        spaced = written(spaced)
        gap = calibrated_gap(spaced)
    begins = spaced.withColumn("begins", (F.col("gap").isNull() | (F.col("gap") > gap)).cast("int"))
    inside = Window.partitionBy("channel", "tick").orderBy("us", "tie").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("channel").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    sums = begins.groupBy("channel", "tick").agg(F.sum("begins").alias("n"))
    before = sums.select("channel", "tick", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    placed = begins.join(before, ["channel", "tick"]).withColumn("session_no", F.col("before") + F.sum("begins").over(inside))
    place = F.struct("us", "tie")
    sides = placed.groupBy("channel", "session_no").agg(F.min_by("speaker", place).alias("user"), F.max_by("speaker", place).alias("last"))
    answered = sides.where("last <> user").select("channel", "session_no", "user")
    kept = placed.join(answered, ["channel", "session_no"])
    sizes = kept.groupBy("channel", "session_no", "tick").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("channel", "session_no").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("channel", "session_no", "tick", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("channel", "session_no", "tick").orderBy("us", "tie")
    return kept.join(starts, ["channel", "session_no", "tick"]).select(
        "channel", "session_no", (F.col("start") + F.row_number().over(within)).alias("message_no"), "at",
        F.when(F.col("speaker") == F.col("user"), "user").otherwise("assistant").alias("role"), "text",
    )
