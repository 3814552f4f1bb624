from __future__ import annotations

from tierlabel.llm.common import table
from tierlabel.llm.pages import extract_text
from tierlabel.llm.registry import query


@query("op12_extract_text")
def op12(spark, folder):
    return extract_text(table(spark, folder, "pages"))
