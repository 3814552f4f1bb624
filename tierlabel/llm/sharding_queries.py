from __future__ import annotations

from tierlabel.llm.common import table
from tierlabel.llm.registry import query
from tierlabel.llm.sharding import shard_documents


@query("op10_shard_documents")
def op10(spark, folder):
    return shard_documents(table(spark, folder, "documents"))
