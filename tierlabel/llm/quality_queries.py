from __future__ import annotations

from tierlabel.llm.common import table
from tierlabel.llm.quality import assess
from tierlabel.llm.registry import query


@query("op7_quality_cascade")
def op7(spark, folder):
    return assess(table(spark, folder, "documents"))
