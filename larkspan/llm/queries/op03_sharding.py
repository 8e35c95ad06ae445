"""op3: every document's shard and slot along the Hilbert curve."""

from larkspan.llm import hilbert
from larkspan.llm.registry import query
from larkspan.llm.shared import documents


@query("op3_hilbert_sharding")
def op3_hilbert_sharding(spark, sf_dir):
    return hilbert.shard(documents(spark, sf_dir))
