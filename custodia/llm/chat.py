"""Chat formatting with the perspective rotated over all participants.

Every participant of a conversation gets a rendering of the dialogue in
which their turns are the assistant's and are trained on, and the other
participants are users with a name. System turns are context: they keep
their role and have no perspective of their own.

A rendering is cut into parts of a fixed number of turns, so no row holds
an unbounded conversation; the parts of a rendering, in order, are the
whole. Turns are numbered in two levels (inside ranges of turn numbers,
then over these ranges), which splits a conversation with most of the rows.

Defined cases: turns are in order of turn (NULL first), role and text, ties
and repeated rows all stay; a NULL role is the participant ``unknown``; a
NULL text is empty; a NULL conv_id is one conversation; a conversation with
only system turns has no rendering; markers that occur inside a text
are broken by a space, in a name written in percent notation; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256
_RANGE = 256
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _name(role: Column) -> Column:
    """Roles as names without white space or markers, one name per role."""
    name = F.regexp_replace(role.cast("string"), "%", "%25")
    for c in " \t\n\x0b\f\r":
        name = F.regexp_replace(name, re.escape(c), f"%{ord(c):02X}")
    name = F.regexp_replace(name, r"<\|", "%3C|")
    return F.coalesce(F.when(name == "unknown", F.lit("%75nknown")).otherwise(name), F.lit("unknown"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Per conversation, speaker and part: conv_id, speaker, part, n_turns,
    text, spans (begin and end of what is trained on, in characters of the
    text) and n_trained (characters in the spans)."""
    plain = lambda c, empty: F.regexp_replace(F.coalesce(c, F.lit(empty)), r"<\|", "< |")
    turns = conversations.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        _name(F.col("role")).alias("role"),
        plain(F.col("text").cast("string"), "").alias("text"),
        F.col("conv_id").isNull().alias("no_id"))
    turns = turns.withColumn("id", F.coalesce(F.col("conv_id"), F.lit(0).cast(conversations.schema["conv_id"].dataType)))
    turns = turns.withColumn("range", F.floor(F.col("turn") / _RANGE))

    conv = ["no_id", "id"]
    before = Window.partitionBy(*conv).orderBy(F.col("range").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranges = (turns.groupBy(*conv, "range").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(before) - F.col("n")))
    inside = Window.partitionBy(*conv, "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    key = F.coalesce("range", F.lit(-(1 << 62)))
    placed = (turns.withColumn("nth", F.row_number().over(inside)).withColumn("key", key)
              .join(ranges.select(*conv, key.alias("key"), "before"), [*conv, "key"])
              .withColumn("nth", F.col("before") + F.col("nth") - 1))

    speakers = turns.filter(F.lower("role") != "system").select(*conv, F.col("role").alias("speaker")).distinct()
    mine, system = F.col("role") == F.col("speaker"), F.lower("role") == "system"
    head = F.concat(F.lit(BEGIN),
                    F.when(system, F.lit("system")).when(mine, F.lit("assistant"))
                    .otherwise(F.concat(F.lit("user name="), F.col("role"))), F.lit("\n"))
    pieces = (placed.join(speakers, conv)
              .withColumn("part", F.floor(F.col("nth") / part_turns))
              .withColumn("head", head)
              .withColumn("piece", F.concat("head", "text", F.lit(END + "\n"))))
    group = [*conv, "speaker", "part"]
    so_far = Window.partitionBy(*group).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.col("stop") - F.length("piece") + F.length("head")
    span = F.when(mine, F.struct(begin.cast("int").alias("begin"), (F.col("stop") - 1).cast("int").alias("end")))
    rows = (pieces.withColumn("stop", F.sum(F.length("piece")).over(so_far))
            .groupBy(*group).agg(
                F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_turns"),
                F.array_sort(F.collect_list(F.struct("nth", "piece"))).alias("pieces"),
                F.array_sort(F.collect_list(span)).alias("spans")))
    trained = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select("conv_id", "speaker", F.col("part").cast("long").alias("part"), "n_turns",
                       F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"),
                       "spans", trained.alias("n_trained"))
