"""Conversations from message rows.

Rows are sessionized by their channel (``session_id``), roles are inferred
from their spellings, stored-again messages are resolved to the row with the
largest id, and sessions without reciprocal replies are dropped with a reason.
The times of what is left are sorted, and inactivity gaps, calibrated on the
table itself, split each conversation into segments.

Every step groups by session *and* turn (or by session and day) before it
groups by session, so a session with a third of all rows is pre-aggregated in
many tasks; texts are shuffled by session and turn once, and only for sound
sessions. Times are sorted within a session and day; only the first and last moment
and the number of segments of each day are carried over.

The gap that splits is ``factor`` times the gap that the given share of messages
that follow each other doesn't exceed, to the next step of an eighth on a
logarithmic scale: a count of gaps by steps finds it, however many there are.

Defined cases: messages without a time are in no segment; rows with null or empty session id belong to no session; a null
turn, an unknown, blank or null role make a session broken; null contents and
contents of white space and zero-width characters are blank; null ids lose
against any id; ties keep one row; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import is_blank, strip

#: Spellings of the four known roles (fixed values).
ROLES = {
    "user": ("user", "human"),
    "assistant": ("assistant", "ai", "bot"),
    "system": ("system",),
    "tool": ("tool",),
}
#: Steps of a natural logarithm in which gaps are counted.
STEPS = 8
#: Question before answer within a turn.
ROLE_ORDER = ("system", "user", "tool", "assistant")


def role_of(c: Column) -> Column:
    """The known role that a spelling means, or null."""
    folded = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for role, spellings in ROLES.items():
        out = F.when(folded.isin(*spellings), F.lit(role)).otherwise(out)
    return out


def _rows(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("session_id").isNotNull() & (F.col("session_id") != "")).select(
        "session_id",
        "turn",
        role_of(F.col("role")).alias("role"),
        F.coalesce(F.col("id"), F.lit(-(2**63))).alias("id"),
        "content",
        F.col("created_at").cast("timestamp").alias("created_at"),
    )


def verdicts(turns: DataFrame) -> DataFrame:
    """``session_id, reasons``: for every session the array of reasons against it, empty for a sound one."""
    keyed = _rows(turns).select("session_id", "turn", "role", "id", (~is_blank(F.col("content"))).alias("said"))
    message = keyed.groupBy("session_id", "turn", "role").agg(F.max_by("said", "id").alias("said"))
    user = F.max((F.col("role") == "user") & F.col("said"))
    assistant = F.max((F.col("role") == "assistant") & F.col("said"))
    turn = (
        message.groupBy("session_id", "turn")
        .agg(
            F.coalesce(user, F.lit(False)).alias("asked"),
            F.coalesce(assistant, F.lit(False)).alias("answered"),
            F.max(F.col("role").isNull()).alias("odd"),
        )
        .withColumn("either", F.col("asked") | F.col("answered"))
    )
    numbered = F.when(F.col("either"), F.col("turn"))
    session = turn.groupBy("session_id").agg(
        (~F.max("either")).alias("empty"),
        F.max(F.col("turn").isNotNull() & F.col("asked") & ~F.col("answered")).alias("no_reply"),
        (
            F.max(F.col("turn").isNull() | F.col("odd"))
            | F.max(F.col("answered") & ~F.col("asked"))
            | (F.min(numbered) != 1)
            | (F.max(numbered) != F.count(numbered))
        ).alias("broken"),
    )
    reasons = F.when(F.col("empty"), F.array(F.lit("empty"))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("no_reply"), F.lit("no_reply")),
                F.when(F.coalesce(F.col("broken"), F.lit(True)), F.lit("broken")),
            ),
            lambda x: x.isNotNull(),
        )
    )
    return session.select("session_id", reasons.alias("reasons"))


def dropped(turns: DataFrame) -> DataFrame:
    """``session_id, reason``: one row for each dropped session and each reason."""
    return verdicts(turns).select("session_id", F.explode("reasons").alias("reason"))


def _sound(turns: DataFrame) -> DataFrame:
    """The rows of all sound sessions."""
    sound = verdicts(turns).where(F.size("reasons") == 0).select("session_id")
    return _rows(turns).join(sound, "session_id", "left_semi")


def limit_us(gaps: DataFrame, share: float = 0.99, factor: float = 4.0) -> DataFrame:
    """One row ``limit_us`` from ``gap_us``: the calibrated gap. No row if there are no gaps."""
    steps = (
        gaps.where(F.col("gap_us").isNotNull())
        .groupBy(F.floor(F.ln(F.greatest("gap_us", F.lit(1))) * STEPS).alias("step"))
        .agg(F.count("*").alias("n"))
    )
    # one row for each step, of which a time scale has a few hundred
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    reached = steps.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") >= F.col("total") * share)
    return reached.groupBy().agg((F.exp((F.min("step") + 1) / STEPS) * factor).alias("limit_us")).where(F.col("limit_us").isNotNull())


def _segmented(rows: DataFrame, share: float, factor: float) -> DataFrame:
    """``session_id, turn, role, us, segment`` of each message that is said and has a time; ``rows`` are those of sound sessions."""
    light = rows.select(
        "session_id", "turn", "role", "id", (~is_blank(F.col("content"))).alias("said"), F.unix_micros("created_at").alias("us")
    )
    timed = (
        light.groupBy("session_id", "turn", "role")
        .agg(F.max_by(F.struct("said", "us"), "id").alias("m"))
        .where(F.col("m.said") & F.col("m.us").isNotNull())
        .select("session_id", "turn", "role", "m.us", F.floor(F.col("m.us") / F.lit(86_400_000_000)).alias("day"))
    )
    within = Window.partitionBy("session_id", "day").orderBy("us", "turn", "role")
    timed = timed.repartition("session_id", "day").withColumn("before", F.lag("us").over(within))
    ends = timed.groupBy("session_id", "day").agg(F.max("us").alias("last_us"))
    across = Window.partitionBy("session_id").orderBy("day")
    carried = ends.select("session_id", "day", F.lag("last_us").over(across).alias("carried"))
    placed = timed.join(carried, ["session_id", "day"]).withColumn(
        "gap_us", F.col("us") - F.coalesce(F.col("before"), F.col("carried"))
    )
    opened = placed.join(F.broadcast(limit_us(placed, share, factor)), how="left").withColumn(
        "opens", (F.col("gap_us").isNull() | (F.col("gap_us") > F.col("limit_us"))).cast("int")
    )
    daily = opened.groupBy("session_id", "day").agg(F.sum("opens").alias("n_opens"))
    earlier = Window.partitionBy("session_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offset = daily.select("session_id", "day", F.coalesce(F.sum("n_opens").over(earlier), F.lit(0)).alias("offset"))
    so_far = F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        opened.withColumn("in_day", so_far)
        .join(offset, ["session_id", "day"])
        .select("session_id", "turn", "role", "us", (F.col("offset") + F.col("in_day")).cast("int").alias("segment"))
    )


def conversations(turns: DataFrame, share: float = 0.99, factor: float = 4.0) -> DataFrame:
    """The messages of all sound sessions: ``session_id, turn, position, role, content, id, created_at, segment``.

    ``position`` counts a turn's messages from 1, question before answer, so
    (``turn``, ``position``) orders a conversation; ``segment`` counts the stretches
    without a long silence. Blank messages are left out.
    """
    rows = _sound(turns)
    message = (
        rows.repartition("session_id", "turn")
        .groupBy("session_id", "turn", "role")
        .agg(F.max_by(F.struct("content", "created_at", "id"), "id").alias("m"))
        .where(~is_blank(F.col("m.content")))
    )
    # a turn of a sound session has one message of each known role at most
    by_role = F.map_from_entries(F.collect_list(F.struct("role", "segment"))).alias("by_role")
    placed = _segmented(rows, share, factor).groupBy("session_id", "turn").agg(by_role)
    rank = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role"))
    position = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy(rank))
    return message.join(placed, ["session_id", "turn"], "left").select(
        "session_id",
        "turn",
        position.cast("int").alias("position"),
        "role",
        F.col("m.content").alias("content"),
        F.col("m.id").alias("id"),
        F.col("m.created_at").alias("created_at"),
        F.try_element_at("by_role", F.col("role")).alias("segment"),
    )


def segments(turns: DataFrame, share: float = 0.99, factor: float = 4.0) -> DataFrame:
    """The segments of ``conversations``: ``session_id, segment, first_us, last_us, n_messages, n_turns``."""
    return (
        _segmented(_sound(turns), share, factor)
        .groupBy("session_id", "segment")
        .agg(
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.count("*").alias("n_messages"),
            F.count_distinct("turn").alias("n_turns"),
        )
    )
