from __future__ import annotations

from pyspark.sql import functions as F

from tierlabel.llm.brown import score_documents
from tierlabel.llm.common import table
from tierlabel.llm.registry import query


@query("op9_brown_scores")
def op9(spark, folder):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score_documents(table(spark, folder, "documents"), held_out)
