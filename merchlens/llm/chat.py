"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
participant as the assistant and everybody else as a named user.  The mask holds the
spans a model is trained on: what the assistant of this rendering says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.ordinals import numbered
from merchlens.llm.registry import query, read

START, END = "<|im_start|>", "<|im_end|>"
# Speakers that set the scene: shown in every rendering, never its assistant.
CONTEXT = ("system",)
TURNS_PER_ROW = 256


def perspectives(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    context: tuple[str, ...] = CONTEXT,
    turns_per_row: int = TURNS_PER_ROW,
) -> DataFrame:
    """One row per conversation, participant and part of ``turns_per_row`` turns.

    Columns: conv_id, perspective, part (from 0), first_turn (place of the part's first
    turn), n_turns, rendered, mask (array of [start, stop) code points of ``rendered``),
    n_trained.  Parts of a conversation concatenate to the whole dialogue; usual
    conversations are one part, and a conversation of any length needs no large row.

    Turns are ordered by turn (null last), then speaker and text; repeated turns are
    all rendered.  A null speaker is a participant called ``unknown``, a null text is an
    empty turn, rows of a null conversation form one conversation.  A conversation
    without participants (context only) has no rendering.  Speaker names lose white
    space and angle brackets in the header line.  Other columns are ignored.
    """
    slim = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("said"),
    )
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("said")]
    placed = numbered(slim, ["conv_id"], order, "place").withColumn(
        "part", F.floor(F.col("place") / turns_per_row)
    )
    parts = placed.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "speaker", "said"))).alias("turns")
    )
    people = slim.filter(~F.col("speaker").isin(*context)).select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")
    ).distinct()
    rotated = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    def name(who):
        return F.regexp_replace(who, r"[\s<>]+", "_")

    def head(t):
        role = (
            F.when(t.speaker.isin(*context), t.speaker)
            .when(t.speaker == F.col("perspective"), F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), name(t.speaker)))
        )
        return F.concat(F.lit(START), role, F.lit("\n"))

    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            head(t).alias("head"),
            F.concat(t.said, F.lit(END)).alias("body"),
            ((t.speaker == F.col("perspective")) & ~t.speaker.isin(*context)).alias("own"),
        ),
    )
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "")
    span = "struct<start:int,stop:int>"
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda acc, p: F.struct(
            (acc.at + F.length(p.head) + F.length(p.body) + 1).alias("at"),
            F.when(
                p.own,
                F.concat(
                    acc.spans,
                    F.array(
                        F.struct(
                            (acc.at + F.length(p.head)).alias("start"),
                            (acc.at + F.length(p.head) + F.length(p.body)).alias("stop"),
                        ).cast(span)
                    ),
                ),
            )
            .otherwise(acc.spans)
            .alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    trained = F.aggregate("mask", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    return (
        rotated.withColumn("pieces", pieces)
        .select(
            "conv_id",
            "perspective",
            "part",
            F.get("turns", F.lit(0)).place.alias("first_turn"),
            F.size("turns").cast("bigint").alias("n_turns"),
            rendered.alias("rendered"),
            spans.alias("mask"),
        )
        .withColumn("n_trained", trained)
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place
  FROM conversations),
r AS (
  SELECT t.*, p.perspective, t.speaker = p.perspective AS own,
         '<|im_start|>' || CASE WHEN t.speaker = 'system' THEN t.speaker WHEN t.speaker = p.perspective THEN 'assistant'
           ELSE 'user name=' || regexp_replace(t.speaker, '[\s<>]+', '_', 'g') END || chr(10) AS head,
         t.said || '<|im_end|>' AS body
  FROM t JOIN (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system') p
    ON t.conv_id IS NOT DISTINCT FROM p.c),
s AS (
  SELECT *, place // 256 AS part,
         coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, place // 256 ORDER BY place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
  FROM r)
SELECT conv_id, perspective, part, min(place) AS first_turn, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY place) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(pos AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY place), '') AS mask,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS n_trained
FROM s GROUP BY conv_id, perspective, part
"""


@query("op8_chat_perspectives", OP8_SQL)
def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from the view of each of its participants."""
    out = perspectives(read(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s.start.cast("string"), s.stop.cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))
