"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all other
speakers as named users; a mask marks the assistant's own turns (the training targets). A rendering is a sequence of
turns with their place in it, one row per turn, so a dialogue of any length stays distributed:

    <|assistant|>\\n{text}\\n          a turn of the speaker whose perspective it is
    <|user name={speaker}|>\\n{text}\\n   a turn of anyone else

Places are prefix sums of the turns' lengths. The dialogues are range-partitioned by (conv_id, turn, speaker, text), which
cuts a long one into runs of about ``RUN`` rows whatever its turn numbers are: sums per run first, then the runs' own
prefix sums, then the turns inside a run, so no window spans more than a run or the list of runs. Equal rows are counted
before that and written out at the end, so that repeats, which no range can part, are one row.

No text can forge a turn: in texts and names a backslash is doubled and ``<|`` becomes ``<\\|``; in names ``|>`` becomes ``|\\>`` and a
line break ``\\n`` besides. Lengths and places count the escaped text.

System turns belong to nobody: they have no perspective and keep their own header in all of them.

Defined results: a null text is empty, a null speaker is called "unknown"; turns are ordered by turn number
(null first), then speaker and text, so ties and repeated rows have a defined order up to equal rows; rows with null
conv_id form one conversation of their own; a dialogue with system turns alone has no participant and no rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.llm.common import written

RUN = 65_536
SYSTEM = "system"


def escaped(text):
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_name(name):
    return F.replace(F.replace(escaped(name), F.lit("|>"), F.lit("|\\>")), F.lit("\n"), F.lit("\\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, is_target, rendered, start and end (in the whole rendering)."""
    said = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    said = written(said.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies")), "turns")
    ranges = max(1, -(-said.count() // RUN))
    dealt = said.repartitionByRange(ranges, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text"))
    said = written(dealt.withColumn("run", F.spark_partition_id()), "runs")
    order = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    numbered = said.withColumn("in_run", F.row_number().over(order))
    people = said.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    met = numbered.alias("t").join(people.alias("p"), F.col("t.conv_id").eqNullSafe(F.col("p.conv_id"))).select("t.*", "p.perspective")
    own = F.col("speaker") == F.col("perspective")
    header = (
        F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>"))
        .when(own, F.lit("<|assistant|>"))
        .otherwise(F.concat(F.lit("<|user name="), escaped_name(F.col("speaker")), F.lit("|>")))
    )
    turns = met.select("*", own.alias("is_target"), F.concat(header, F.lit("\n"), escaped(F.col("text")), F.lit("\n")).alias("rendered"))
    turns = turns.withColumn("length", F.length("rendered").cast("long"))
    chars = F.col("length") * F.col("copies")
    runs = turns.groupBy("conv_id", "perspective", "run").agg(F.sum(chars).alias("chars"), F.sum("copies").alias("turns"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = runs.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("s"), F.col("run").alias("r"),
        F.coalesce(F.sum("chars").over(before), zero).alias("chars_before"), F.coalesce(F.sum("turns").over(before), zero).alias("turns_before"),
    )
    placed = turns.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("s")) & (F.col("run") == F.col("r")))
    inside = Window.partitionBy("conv_id", "perspective", "run").orderBy("in_run").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        "*", (F.col("chars_before") + F.coalesce(F.sum(chars).over(inside), zero)).alias("from_char"),
        (F.col("turns_before") + F.coalesce(F.sum("copies").over(inside), zero)).alias("from_turn"),
    )
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    start = F.col("from_char") + (F.col("copy") - 1) * F.col("length")
    return each.select(
        "conv_id", "perspective", (F.col("from_turn") + F.col("copy")).alias("position"), "turn", "speaker", "is_target", "rendered",
        start.alias("start"), (start + F.col("length")).alias("end"),
    )


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) AS position FROM said
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), rendered AS (
  SELECT n.conv_id, p.perspective, n.position, n.turn, n.speaker, n.speaker = p.perspective AS is_target,
         CASE WHEN n.speaker = 'system' THEN '<|system|>'
              WHEN n.speaker = p.perspective THEN '<|assistant|>'
              ELSE '<|user name=' || replace(replace(replace(replace(n.speaker, '\', '\\'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n') || '|>' END
         || chr(10) || replace(replace(n.text, '\', '\\'), '<|', '<\|') || chr(10) AS rendered
  FROM numbered n JOIN people p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS BIGINT) AS "end" FROM rendered
)
SELECT conv_id, perspective, position, turn, speaker, is_target, rendered, "end" - length(rendered) AS start, "end" FROM placed
"""
