"""Chat formatting by rotation of perspectives.

Every participant of a conversation gets a rendering in which its turns are the
assistant's and all others' are named users', with the spans that a model is
trained on: the texts of the assistant's turns and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed marks of the rendering.
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Turns are dealt into parts by their place in the conversation, so one of any length is rendered in pieces of so many turns.
PART_TURNS = 4096


def _plain(text: Column) -> Column:
    """Marks within a text or name are broken up, so that they can't end a turn."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(BEGIN), F.lit("<| im_start |>")), F.lit(END), F.lit("<| im_end |>"))


def rotate_perspectives(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """A row for each conversation, part and participant: rendered (text), spans (start and end in code points) and n_turns.

    Turns are in the order of turn number, role and text; null numbers come
    first.  A null role takes part as ``unknown``, a null text is empty.  Repeated
    rows are repeated turns.  A null conversation is a conversation.  Part p
    has the turns from place part_turns * p on; every participant of the
    conversation has a rendering of every part, and its parts join to the whole.
    """
    role = F.coalesce(F.col(role_col), F.lit("unknown"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), _plain(role).alias("role"), _plain(F.col(text_col)).alias("text")).alias("t"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("t")) - 1
    rows = rows.withColumn("part", F.floor(place / part_turns).cast("bigint"))
    talks = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.collect_set("t.role").alias("roles"))
    people = F.array_distinct(F.flatten(F.collect_set("roles").over(Window.partitionBy("conv"))))
    talks = talks.withColumn("people", F.array_sort(people)).withColumn("participant", F.explode("people"))
    own = lambda t: t["role"] == F.col("participant")
    head = lambda t: F.when(own(t), F.lit(f"{BEGIN}assistant\n")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), t["role"], F.lit("\n")))
    pieces = F.transform("ts", lambda t: F.struct(own(t).alias("own"), head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body")))
    talks = talks.select("conv", "part", "participant", pieces.alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    begin = lambda a, p: a["at"] + F.length(p["head"])
    stop = lambda a, p: begin(a, p) + F.length(p["body"])
    spans = F.aggregate("ps", zero, lambda a, p: F.struct((stop(a, p) + 1).alias("at"), F.when(p["own"], F.array_append(a["out"], F.struct(begin(a, p).alias("start"), stop(a, p).alias("end")))).otherwise(a["out"]).alias("out")))["out"]
    return talks.select(F.col("conv").alias(conv_col), "part", "participant", text.alias("rendered"), spans.alias("spans"), F.size("ps").cast("bigint").alias("n_turns"))
