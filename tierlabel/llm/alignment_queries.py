from __future__ import annotations

from tierlabel.llm.alignment import Tokenizers, alignment_digests
from tierlabel.llm.common import table
from tierlabel.llm.registry import query

BYTE_PIECES = "/opt/tokenizers/byte_bpe_50k.json"
SPACE_PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op11_align_tokenizers")
def op11(spark, folder):
    return alignment_digests(table(spark, folder, "documents"), Tokenizers.read(BYTE_PIECES, SPACE_PIECES))
