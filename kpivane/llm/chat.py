"""Chat formatting by rotating perspectives: every participant in turn is the assistant.

Built-in functions only. A dialogue is rendered as segments in order, one row each, with their place in
the rendered text, so that no conversation has to fit in one task: running places are sums within
blocks of a sorted range plus sums over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import settled

#: The rendered form of a turn.
OPEN, CLOSE, MARK, BROKEN = "<|turn|>", "<|end|>\n", "<|", "< |"
INSTRUCTIONS = ("system",)
UNKNOWN = "unknown"


def _plain(value: Column, absent: str) -> Column:
    """A text without the marks of the rendered form."""
    return F.replace(F.coalesce(value.cast("string"), F.lit(absent)), F.lit(MARK), F.lit(BROKEN))


def perspectives(turns: DataFrame, instructions: tuple[str, ...] = INSTRUCTIONS) -> DataFrame:
    """One row per turn and participant of its conversation, for that participant as the assistant.

    Input: conv_id, turn, role (the speaker's name) and text. Output: conv_id, speaker (the assistant of
    this rendering), position (from 0), turn, chat_role (assistant, user or system), name, segment (the
    rendered turn), start and stop (its place in the rendered dialogue, in characters), mask_start and
    mask_stop (what the loss counts: the assistant's own text and its end mark; equal where nothing).

    Turns are ordered by turn (null first), speaker and text; repeated rows are repeated turns. A null
    text is empty, a null role is the speaker "unknown", and rows without conv_id form one conversation.
    Speakers in `instructions` give no perspective; a conversation of theirs alone gives no rows. Marks
    inside texts and names are broken apart. Other columns are ignored.
    """
    said = turns.select("conv_id", "turn", _plain(F.col("role"), UNKNOWN).alias("name"), _plain(F.col("text"), "").alias("said"))
    order = ["turn", "name", "said"]
    ranged = settled(said.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id()))
    told = ranged.withColumn("instruction", F.col("name").isin(*instructions))
    speakers = told.where("not instruction").select(F.col("conv_id").alias("_conv"), F.col("name").alias("speaker")).distinct()
    blocks = told.select("conv_id", "block").distinct()
    asked = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "speaker")
    own = F.col("name") == F.col("speaker")
    head = (F.when(F.col("instruction"), F.lit("system")).when(own, F.lit("assistant"))
            .otherwise(F.concat(F.lit("user "), "name")))
    rows = (
        told.join(asked, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
        .select("conv_id", "speaker", "block", *order, "instruction", F.concat(F.lit(OPEN), head, F.lit("\n")).alias("_head"))
        .withColumn("segment", F.concat("_head", "said", F.lit(CLOSE)))
        .withColumn("_size", F.length("segment").cast("bigint"))
    )
    dialogue = ["conv_id", "speaker"]
    before = Window.partitionBy(*dialogue).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy(*dialogue, "block").agg(F.sum("_size").alias("_sum"), F.count("*").alias("_rows"))
        .select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("_speaker"), F.col("block").alias("_block"),
                F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
                F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(*dialogue, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.withColumn("_end", F.sum("_size").over(inside)).withColumn("_nth", F.count("*").over(inside))
        .join(bases, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("speaker") == F.col("_speaker")) & (F.col("block") == F.col("_block")))
    )
    stop = F.col("_base") + F.col("_end")
    return placed.select(
        *dialogue, (F.col("_first") + F.col("_nth") - 1).alias("position"), "turn",
        F.when(F.col("instruction"), F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("chat_role"),
        "name", "segment", (stop - F.col("_size")).alias("start"), stop.alias("stop"),
        (stop - F.when(own, F.length("said") + len(CLOSE)).otherwise(F.lit(0))).alias("mask_start"), stop.alias("mask_stop"),
    )


PERSPECTIVES_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, replace(coalesce(role, '{UNKNOWN}'), '{MARK}', '{BROKEN}') AS name, replace(coalesce(text, ''), '{MARK}', '{BROKEN}') AS said,
         row_number() OVER () AS nr
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, name AS speaker FROM said WHERE name <> 'system'
), rendered AS (
  SELECT s.*, p.speaker,
         CASE WHEN s.name = 'system' THEN 'system' WHEN s.name = p.speaker THEN 'assistant' ELSE 'user' END AS chat_role,
         '{OPEN}' || CASE WHEN s.name = 'system' THEN 'system' WHEN s.name = p.speaker THEN 'assistant' ELSE 'user ' || s.name END
           || chr(10) || s.said || '<|end|>' || chr(10) AS segment
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, sum(length(segment)) OVER w AS stop, count(*) OVER w - 1 AS position
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, said, nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, speaker, position, turn, chat_role, name, segment, stop - length(segment) AS start, stop,
       stop - CASE WHEN chat_role = 'assistant' THEN length(said) + {len(CLOSE)} ELSE 0 END AS mask_start, stop AS mask_stop
FROM placed
"""
