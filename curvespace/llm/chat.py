"""Chat formatting: every dialogue from the perspective of each of its participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespace.llm.common import forget, keep, ranked, tagged

START, END = "<|im_start|>", "<|im_end|>"
#: Messages rendered into one row. One dialogue may hold a third of all messages, so a row has to have a bound; a longer
#: dialogue comes in consecutive parts, whose texts joined are the whole.
PART = 64
#: Speakers of this role stay what they are and take no perspective of their own.
SYSTEM = "system"


def _harmless(text: Column) -> Column:
    """A text in which the format's own markers are broken up, so that no message can pose as another."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_(start|end)\|>", "<|im_$1 |>")


def _speaker(role: Column) -> Column:
    """A role as a name: markers broken up as in texts, each run of white space or control characters one space, none at
    the ends; ``unknown`` if nothing is left. So no name can end a header or begin another message."""
    plain = F.regexp_replace(F.regexp_replace(_harmless(role), r"[\x00-\x20\x7f]+", " "), "^ | $", "")
    return F.when(plain == "", "unknown").otherwise(plain)


def perspectives(conversations: DataFrame, part: int = PART, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, mask``: for every participant, the dialogue with that speaker as
    assistant and the others as named users.

    Participants are the distinct roles (as :func:`_speaker` names them) other than ``system``; null or blank roles are one
    participant, ``unknown``.
    ``mask`` lists the character spans of ``text`` to learn from, ``start-end`` joined by commas: the speaker's own
    messages with their end markers. Messages go by turn (null last), then role and text; repeated rows stay. A
    dialogue of more than ``part`` messages comes in parts of that many, numbered from 0, whose texts joined are the
    whole; spans count from each part's start. Null ``conv_id``: one dialogue. Null text: empty. Dialogues of system
    messages alone, or no rows: no rows. Other columns are ignored.
    """
    name = _speaker(F.col(role))
    rows = tagged(conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), name.alias("role"), _harmless(F.col(text)).alias("text")), "rid")
    numbered = keep(ranked(rows, ["conv_id"], "rid", "place", [F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text")]))
    forget(rows)
    who = numbered.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    message = F.struct("place", "role", "text")
    parts = numbered.groupBy("conv_id", F.floor(F.col("place") / part).cast("int").alias("part")).agg(F.array_sort(F.collect_list(message)).alias("m"))
    both = parts.join(who, F.col("conv_id").eqNullSafe(F.col("c")))

    def head(x: Column) -> Column:
        as_ = F.when(x["role"] == F.col("speaker"), "assistant").when(x["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), x["role"]))
        return F.concat(F.lit(START), as_, F.lit("\n"))

    def body(x: Column) -> Column:
        return F.concat(x["text"], F.lit(END))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(head(x))
        end = begin + F.length(body(x))
        span = F.concat(F.when(acc["spans"] == "", "").otherwise(","), begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(x["role"] == F.col("speaker"), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))
    return both.select(
        "conv_id", "speaker", "part", F.size("m").cast("int").alias("n_turns"),
        F.array_join(F.transform("m", lambda x: F.concat(head(x), body(x), F.lit("\n"))), "").alias("text"),
        F.aggregate("m", zero, step, lambda acc: acc["spans"]).alias("mask"),
    )


def oracle(part: int = PART) -> str:
    """DuckDB SQL for :func:`perspectives` over ``conversations`` of non-null ids."""
    return rf"""
WITH r0 AS (
  SELECT conv_id, turn, trim(regexp_replace(regexp_replace(coalesce(role, ''), '<\|im_(start|end)\|>', '<|im_\1 |>', 'g'), '[\x00-\x20\x7f]+', ' ', 'g')) AS role,
         regexp_replace(coalesce(text, ''), '<\|im_(start|end)\|>', '<|im_\1 |>', 'g') AS text FROM conversations
), n AS (
  SELECT conv_id, turn, CASE WHEN role = '' THEN 'unknown' ELSE role END AS role, text FROM r0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn IS NULL, turn, role, text) - 1 AS place FROM n
), w AS (
  SELECT DISTINCT conv_id, role AS speaker FROM n WHERE role <> '{SYSTEM}'
), r AS (
  SELECT p.conv_id, w.speaker, CAST(p.place // {part} AS INTEGER) AS part, p.place, p.role = w.speaker AS mine,
         '{START}' || CASE WHEN p.role = w.speaker THEN 'assistant' WHEN p.role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || p.role END || chr(10) AS head,
         p.text || '{END}' AS body
  FROM p JOIN w ON p.conv_id = w.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM r
)
SELECT conv_id, speaker, part, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(CAST(begins + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + length(head) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (mine), '') AS mask
FROM o GROUP BY conv_id, speaker, part"""
