"""Multi-party perspective rotation of dialogues.

For every participant (role other than system) of a conversation the dialogue is rendered once with that speaker as
assistant and the others as named users; the spans of the assistant's contents, which training is to see, are
given as character offsets.

Scale: one shuffle by conversation; each one is then a single row whose renderings are made by higher-order functions,
without Python. A conversation has to fit in a row, as its renderings do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, speaker, text, mask, masked): the dialogue from each speaker's perspective.

    Reads conv_id, turn, role and text. ``mask`` has the spans 'start-end' of the speaker's contents in
    ``text``, in characters, end excluded, joined by commas; ``masked`` is the number of characters in them. A
    null or blank role is the participant 'unknown', a null text an empty content. Turns are ordered by turn (null
    first), then role, then text; repeated rows are turns of their own. System turns stay system turns and are no
    participant's, so a conversation of nothing else gives no row. Rows with a null conv_id are left out.
    """
    role = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit("unknown")).otherwise(F.trim("role"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    each = convs.withColumn("speaker", F.explode(F.array_distinct(F.transform(F.filter("ts", lambda t: t.role != "system"), lambda t: t.role))))

    def opening(t):
        return F.concat(F.lit(OPEN), F.when(t.role == "system", F.lit("system")).when(t.role == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t.role)), F.lit("\n"))

    parts = each.withColumn("ps", F.transform("ts", lambda t: F.struct((t.role == F.col("speaker")).alias("mine"), opening(t).alias("head"), t.text.alias("text"))))

    ends = F.aggregate(
        "ps",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("masked")),
        lambda a, p: F.struct(
            (a.at + F.length(p.head) + F.length(p.text) + F.lit(len(CLOSE))).alias("at"),
            F.when(p.mine, F.concat(a.spans, F.array(F.concat_ws("-", (a.at + F.length(p.head)).cast("string"), (a.at + F.length(p.head) + F.length(p.text)).cast("string"))))).otherwise(a.spans).alias("spans"),
            (a.masked + F.when(p.mine, F.length(p.text)).otherwise(0)).alias("masked"),
        ),
    )
    text = F.array_join(F.transform("ps", lambda p: F.concat(p.head, p.text, F.lit(CLOSE))), "")
    return parts.withColumn("m", ends).select("conv_id", "speaker", text.alias("text"), F.array_join("m.spans", ",").alias("mask"), F.col("m.masked").alias("masked"))


ROTATION_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role COLLATE "C", text COLLATE "C") AS k FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (
  SELECT n.conv_id, s.speaker, n.k, n.text, n.role = s.speaker AS mine,
    '<|im_start|>' || CASE WHEN n.role = 'system' THEN 'system' WHEN n.role = s.speaker THEN 'assistant' ELSE 'user name=' || n.role END || chr(10) AS head
  FROM n JOIN s ON n.conv_id = s.conv_id),
o AS (SELECT *, CAST(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS BIGINT) - 11 AS stop FROM p)
SELECT conv_id, speaker, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
  string_agg((stop - length(text)) || '-' || stop, ',' ORDER BY k) FILTER (WHERE mine) AS mask,
  CAST(sum(length(text)) FILTER (WHERE mine) AS INT) AS masked
FROM o GROUP BY conv_id, speaker
"""
