"""op2: every document's token ids, written as patched frame-of-reference files and read back."""

import public_tokenizers

from larkspan.llm import token_files
from larkspan.llm.registry import query
from larkspan.llm.shared import documents

END_ID = 2


@query("op2_patched_frames")
def op2_patched_frames(spark, sf_dir):
    return token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), END_ID)
