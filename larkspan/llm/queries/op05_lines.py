"""op5: what each document keeps when one line stays of each group of alike lines."""

from larkspan.llm import line_dedup
from larkspan.llm.registry import query
from larkspan.llm.shared import documents


@query("op5_fuzzy_lines")
def op5_fuzzy_lines(spark, sf_dir):
    return line_dedup.dedup(documents(spark, sf_dir))
