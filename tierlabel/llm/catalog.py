"""All registered queries of this subpackage."""

from tierlabel.llm import alignment_queries, brown_queries, centroids_queries, chat_queries, decontaminate_queries, licenses_queries, minhash_queries, mixing_queries, pages_queries, quality_queries, sharding_queries, tokens_queries, warc_queries  # noqa: F401
from tierlabel.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
