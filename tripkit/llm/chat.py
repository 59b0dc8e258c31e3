"""Chat formatting: every dialogue once from each participant's perspective.

For a participant, its own turns are those of the assistant and are trained on; all other
turns are those of users under their names. Built of DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripkit.operators.layout import checkpointed, with_position

PART_TURNS = 64
# How a turn is written.
ASSISTANT_HEAD = "<|assistant|>\n"
USER_HEAD = "<|user name="
HEAD_END = "|>\n"
TURN_END = "<|end|>\n"
NARRATOR = "system"
SYSTEM_HEAD = "<|system|>\n"


# How text that could pass for a mark is written, in this order.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("|>", "|&gt;"))


def escaped(text: Column) -> Column:
    """``text`` without the characters of a mark; the replacements can be undone in reverse order."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def _segments(speaker: Column, viewer: Column, text: Column) -> tuple[Column, Column, Column]:
    """Head, body and mask of a turn as ``viewer`` sees it; neither names nor texts can pass for marks."""
    own = speaker == viewer
    head = (
        F.when(own, F.lit(ASSISTANT_HEAD))
        .when(speaker == NARRATOR, F.lit(SYSTEM_HEAD))
        .otherwise(F.concat(F.lit(USER_HEAD), escaped(speaker), F.lit(HEAD_END)))
    )
    return head, F.concat(escaped(text), F.lit(TURN_END)), own.cast("int")


def rotate_perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """``(conv_id, participant, part, n_turns, rendered, spans)``: a dialogue per participant.

    ``rendered`` is the dialogue as text, ``spans`` an array of ``(start, length, mask)`` in
    characters that covers it without gaps: heads have mask 0, bodies 1 if the participant
    speaks. Everyone who speaks takes part, but for ``system``, whose turns stand for nobody.

    A dialogue is cut after every ``part_turns`` turns, so that a long one is never gathered in
    one row; every participant of the dialogue sees every part. Turns with equal numbers
    follow one another by speaker and text; a repeated row is a turn of its own. A NULL text
    is empty, a NULL speaker is named ``unknown``, a NULL turn counts as -1; a NULL conversation
    is a conversation. Extra columns are ignored; no rows give none.

    Turns are numbered over the whole table, in the order of a range sort that also splits
    long dialogues; a turn's number in its dialogue is what it has more than the first.
    """
    slim = turns.select(
        F.col(conversation).alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    numbered = with_position(
        slim, *[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "speaker", "text")], out="place"
    )
    first = checkpointed(numbered.groupBy(F.col("conv_id").alias("first_of")).agg(F.min("place").alias("first")))
    parts = numbered.join(first, F.col("conv_id").eqNullSafe(F.col("first_of"))).select(
        "conv_id",
        F.floor((F.col("place") - F.col("first")) / part_turns).cast("long").alias("part"),
        "place",
        "speaker",
        "text",
    )
    dialogues = parts.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns")
    )
    people = (
        slim.where(F.col("speaker") != NARRATOR)
        .select(F.col("conv_id").alias("of"), F.col("speaker").alias("participant"))
        .distinct()
    )
    seen = dialogues.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def pieces(t: Column) -> Column:
        head, body, mask = _segments(t["speaker"], F.col("participant"), t["text"])
        return F.array(
            F.struct(head.alias("text"), F.lit(0).alias("mask")), F.struct(body.alias("text"), mask.alias("mask"))
        )

    rendered = seen.withColumn("pieces", F.flatten(F.transform("turns", pieces)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,mask:int>>").alias("spans"))

    def add(so_far: Column, piece: Column) -> Column:
        span = F.struct(so_far["at"].alias("start"), F.length(piece["text"]).alias("length"), piece["mask"].alias("mask"))
        return F.struct(
            (so_far["at"] + F.length(piece["text"])).alias("at"), F.concat(so_far["spans"], F.array(span)).alias("spans")
        )

    return rendered.select(
        "conv_id",
        "participant",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("rendered"),
        F.aggregate("pieces", start, add)["spans"].alias("spans"),
    )
