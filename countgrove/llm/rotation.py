"""Chat formatting by rotating the perspective through all speakers of a dialogue.

For every speaker the whole dialogue is rendered once with that speaker as the assistant and
all others as named users; narrators (system messages) keep their part in every perspective.
A rendered turn carries its place in the rendering and a mask: the character span that is
trained on, which is the speaker's own text with its end mark.

A dialogue is a set of rows, not one string. The table is cut once into ranges of its order, and
a turn is known by its place in there. Running sums go over lengths only, inside ranges and over
the ranges, so a dialogue of any length, or turns that all have one number, are spread over many
tasks. Texts are rendered last, where they meet the places of their turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written

NARRATORS = ("system",)
END = "<|end|>\n"
UNNAMED = "unknown"


def _head(perspective: Column, speaker: Column, narrators) -> Column:
    """Opening mark of a turn as one perspective sees it."""
    return (F.when(speaker.isin(*narrators), F.lit("<|system|>\n"))
            .when(speaker == perspective, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), speaker, F.lit("|>\n"))))


def rotate(turns: DataFrame, dialogue_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
           text_col: str = "text", narrators=NARRATORS) -> DataFrame:
    """(dialogue, perspective, turn, speaker, rendered, start, mask_start, mask_end), a row per rendered turn.

    `rendered` concatenated by (turn, start) is the dialogue of a perspective, and `start` the
    character it begins at; [mask_start, mask_end) is the trained span inside the whole
    rendering, NULL for turns of others. A NULL speaker is one speaker `unknown`; a NULL text
    is empty; rows with a NULL dialogue form one dialogue; NULL turns come first. Turns with
    one number follow each other by speaker and text; repeated rows are turns of their own. A
    dialogue of narrators only has no perspective and gives no rows, as does an empty table.
    Other columns are ignored. Marks inside texts and speakers are not escaped: trust the spans, not
    a search for marks.
    """
    rows = turns.select(
        F.col(dialogue_col).alias("_d"), F.col(turn_col).alias("_t"),
        F.coalesce(F.col(speaker_col), F.lit(UNNAMED)).alias("_s"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.monotonically_increasing_id().alias("_copy"))   # parts repeated rows, which no range could
    order = [F.col("_d").asc_nulls_first(), F.col("_t").asc_nulls_first(), "_s", "_text", "_copy"]
    cut = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("_key"), F.spark_partition_id().alias("_part"), "_d", "_t", "_s", "_text",
        F.char_length("_text").cast("long").alias("_n")), "turns")
    views = (cut.filter(~F.col("_s").isin(*narrators)).select(F.col("_d").alias("_vd"), F.col("_s").alias("_v"))
             .distinct())
    seen = cut.select("_key", "_part", "_d", "_s", "_n").join(views, F.col("_d").eqNullSafe(F.col("_vd")))
    head = _head(F.col("_v"), F.col("_s"), narrators)
    sized = seen.withColumn("_head", F.char_length(head)).withColumn("_len", F.col("_n") + F.col("_head") + len(END))
    inside = Window.partitionBy("_part", "_d", "_v").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_in", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
    parts = sized.groupBy("_part", "_d", "_v").agg(F.sum("_len").alias("_size"))
    earlier = Window.partitionBy("_d", "_v").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(
        F.col("_part").alias("_bp"), F.col("_d").alias("_bd"), F.col("_v").alias("_bv"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_begin"))
    places = placed.join(begins, (F.col("_part") == F.col("_bp")) & F.col("_d").eqNullSafe(F.col("_bd"))
                         & (F.col("_v") == F.col("_bv"))).select(
        F.col("_key").alias("_turn"), "_v", "_head", "_len", (F.col("_begin") + F.col("_in")).alias("start"))
    own = F.col("_s") == F.col("_v")
    return cut.join(places, F.col("_key") == F.col("_turn")).select(
        F.col("_d").alias(dialogue_col), F.col("_v").alias("perspective"), F.col("_t").alias(turn_col),
        F.col("_s").alias("speaker"), F.concat(head, "_text", F.lit(END)).alias("rendered"), "start",
        F.when(own, F.col("start") + F.col("_head")).alias("mask_start"),
        F.when(own, F.col("start") + F.col("_len")).alias("mask_end"))
