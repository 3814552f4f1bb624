from __future__ import annotations

from tierlabel.llm.common import table
from tierlabel.llm.decontaminate import find_leaks
from tierlabel.llm.registry import query


@query("op8_benchmark_leaks")
def op8(spark, folder):
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
