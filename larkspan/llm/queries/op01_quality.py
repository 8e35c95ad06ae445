"""op1: base counts and verdict of every document."""

from larkspan.llm import quality_rules
from larkspan.llm.registry import query
from larkspan.llm.shared import documents


@query("op1_repetition_coverage")
def op1_repetition_coverage(spark, sf_dir):
    return quality_rules.measure(documents(spark, sf_dir))
