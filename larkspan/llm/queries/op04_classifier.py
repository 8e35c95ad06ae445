"""op4: every document's importance weight and whether the resampling keeps it."""

from larkspan.llm import importance
from larkspan.llm.registry import query
from larkspan.llm.shared import documents


@query("op4_importance_resampling")
def op4_importance_resampling(spark, sf_dir):
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
