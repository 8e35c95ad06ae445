"""op6: secrets of every document, with weak candidates linked to their complementary parts."""

from larkspan.llm import secrets
from larkspan.llm.registry import query
from larkspan.llm.shared import documents


@query("op6_multipart_credentials")
def op6_multipart_credentials(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))
