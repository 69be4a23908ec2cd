"""Prefix-target expansion of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrain.llm.common import c

TURN_OPEN, TURN_MID, TURN_CLOSE = "<|", "|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    """A text in which no sign of the template can be read: <| becomes <||, which takes nothing from it."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), role, F.lit(TURN_MID), text, F.lit(TURN_CLOSE))


def prefix_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every assistant turn as an example: all turns before it as the prompt, that reply alone trainable.

    One row an example: conv_id, turn, n_context turns before it, prompt (ends with the opened
    assistant turn), target (the reply and its closing sign), and loss_start and loss_end, the
    trainable span in characters of prompt || target. One shuffle by conversation; the growing
    prompt is a window over the turns in order, so no conversation is joined with itself.

    Template signs inside a role or text are escaped (<| as <||, and |> as ||> in roles), so that no turn can forge
    another; the spans count the escaped text.

    Nulls and odd rows: a turn with no conversation is left out; a null turn number sorts first; a
    null role or text counts as an empty one. A reply without text gives no example, as there is
    nothing to train on, but stays in the context of later ones. Ties in turn go by role, then text;
    repeated rows each count. Other columns are not carried, so none clash. No rows give no rows.
    """
    t = turns.where(c(conv).isNotNull()).select(
        c(conv).alias("conv_id"), c(turn).alias("turn"),
        F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"),
    )
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    role_, text_ = F.replace(escaped(F.col("role")), F.lit("|>"), F.lit("||>")), escaped(F.col("text"))
    t = t.withColumn("said", F.collect_list(_rendered(role_, text_)).over(before))
    prompt = F.concat(F.array_join("said", ""), F.lit(TURN_OPEN + "assistant" + TURN_MID))
    return (
        t.where((F.col("role") == "assistant") & (F.col("text") != ""))
        .select("conv_id", "turn", F.size("said").cast("bigint").alias("n_context"), prompt.alias("prompt"), F.concat(text_, F.lit(TURN_CLOSE)).alias("target"))
        .withColumn("loss_start", F.length("prompt").cast("bigint"))
        .withColumn("loss_end", (F.length("prompt") + F.length("target")).cast("bigint"))
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT *,
    coalesce(string_agg('<|' || replace(replace(role, '<|', '<||'), '|>', '||>') || '|>' || chr(10) || replace(text, '<|', '<||') || '<|end|>' || chr(10), '') OVER w, '')
      || '<|assistant|>' || chr(10) AS prompt,
    count(*) OVER w AS n_context
  FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, turn, CAST(n_context AS BIGINT) AS n_context, prompt, replace(text, '<|', '<||') || '<|end|>' || chr(10) AS target,
  CAST(length(prompt) AS BIGINT) AS loss_start,
  CAST(length(prompt) + length(replace(text, '<|', '<||') || '<|end|>' || chr(10)) AS BIGINT) AS loss_end
FROM s WHERE role = 'assistant' AND text <> ''
"""
