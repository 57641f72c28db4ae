"""Multi-party perspective rotation for chat data.

Every dialogue is rendered once per participant: that speaker is the assistant, all others are
named users, system turns stay system turns. The result has one row per dialogue, perspective and
turn, in a form where joining the ``rendered`` strings of a perspective by turn gives the dialogue;
a dialogue of any length is thus never gathered into one cell. ``mask_start``/``mask_end`` are
the code points of ``rendered`` that training learns from: the text and end mark of the turns of
the speaker who is the assistant, nothing (0, 0) elsewhere.

Participants are found by a pre-aggregated distinct and joined back, so a very long dialogue is a
skewed join key, which adaptive execution splits. Only built-in DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: str = "system",
) -> DataFrame:
    """conv_id, perspective, turn, speaker, chat_role, rendered, mask_start, mask_end.

    A null text is an empty turn. A null speaker is an unnamed user and no perspective; a
    dialogue of system and unnamed turns alone has no perspective and no rows, as have turns
    without a conversation. Turns that tie or repeat are all kept. Other columns are dropped.
    """
    lines = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(speaker).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    speakers = (
        lines.filter(F.col("speaker").isNotNull() & (F.col("speaker") != system))
        .select("conv_id", F.col("speaker").alias("perspective"))
        .distinct()
    )
    role = (
        F.when(F.col("speaker") == system, "system")
        .when(F.col("speaker") == F.col("perspective"), "assistant")
        .otherwise("user")
    )
    header = F.when(
        (F.col("chat_role") == "user") & F.col("speaker").isNotNull(),
        F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n")),
    ).otherwise(F.concat(F.lit("<|"), F.col("chat_role"), F.lit("|>\n")))
    learned = F.col("chat_role") == "assistant"
    begin = F.length("_header")
    return (
        lines.join(speakers, "conv_id")
        .withColumn("chat_role", role)
        .withColumn("_header", header)
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            "chat_role",
            F.concat("_header", "_text", F.lit(END + "\n")).alias("rendered"),
            F.when(learned, begin).otherwise(0).alias("mask_start"),
            F.when(learned, begin + F.length("_text") + len(END)).otherwise(0).alias("mask_end"),
        )
    )
