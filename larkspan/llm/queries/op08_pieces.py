"""op8: every document's token ids and the text they decode to, as digests."""

import public_tokenizers

from larkspan.llm import pieces
from larkspan.llm.registry import query
from larkspan.llm.shared import documents


@query("op8_piece_agenda")
def op8_piece_agenda(spark, sf_dir):
    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
