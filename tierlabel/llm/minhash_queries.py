from __future__ import annotations

from tierlabel.llm.common import table
from tierlabel.llm.minhash import near_duplicates
from tierlabel.llm.registry import query


@query("op5_near_duplicates")
def op5(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
