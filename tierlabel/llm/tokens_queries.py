from __future__ import annotations

from tierlabel.llm.common import table
from tierlabel.llm.registry import query
from tierlabel.llm.tokens import sentencepiece_vocabulary, token_counts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query("op2_token_counts")
def op2(spark, folder):
    return token_counts(table(spark, folder, "documents"), sentencepiece_vocabulary(VOCABULARY))
