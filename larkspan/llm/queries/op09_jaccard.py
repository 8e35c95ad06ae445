"""op9: components of documents whose sets of four-word shingles are 85 % alike."""

from larkspan.llm import partenum
from larkspan.llm.registry import query
from larkspan.llm.shared import documents


@query("op9_partenum")
def op9_partenum(spark, sf_dir):
    return partenum.jaccard_components(documents(spark, sf_dir), ngram=4, percent=85)
