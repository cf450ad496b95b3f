"""Incremental data pipelines on Spark: rules expanded over grids, stale tasks found by DataFrame plans, run as Spark jobs."""

from freshet.functions.errors import Defer, FreshetError, LookupFailed, QueryError, SignatureError
from freshet.plans.execute import Executor, LocalExecutor, SparkExecutor, run
from freshet.plans.model import Pipeline, Rule, load_pipeline, rule
from freshet.plans.planner import plan
from freshet.sources.matrix import deferrable
from freshet.sources.outputs import Output, array_store, spark_table
from freshet.sources.state import ParquetStore, StateStore

__all__ = [
    "Defer", "Executor", "FreshetError", "LocalExecutor", "LookupFailed", "Output", "ParquetStore", "Pipeline", "QueryError", "Rule", "SignatureError",
    "SparkExecutor", "StateStore", "array_store", "deferrable", "load_pipeline", "plan", "rule", "run", "spark_table",
]
