from __future__ import annotations

from pyspark.sql import functions as F

from tierlabel.llm.chat import CONTROL, format_conversations, loss_text
from tierlabel.llm.common import table
from tierlabel.llm.registry import query


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


_CONFLICT = " OR ".join(f"contains(text, '{c}')" for c in CONTROL)

SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
), t AS (
  SELECT *, 7 + length({_escaped("role")}) + CASE WHEN role = 'assistant' THEN 7 ELSE 6 END
            + CASE WHEN {_CONFLICT} THEN 1 + length({_escaped("text")}) ELSE length(text) END AS chars
  FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op6_chat_round_trip", SQL)
def op6(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(own).alias("text"),
    )
    formatted = format_conversations(rows.union(extra))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
