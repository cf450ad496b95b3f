"""Which tasks are to run, and why.

For each rule, in topological order: its tasks are left-joined with the records of that rule; own reasons are flags over code ids,
compared once for each distinct id on the driver; what reruns upstream comes in as a semi-join on the kwargs (shared
matrix) or as one fact (any other edge); clocks of the upstream tasks are joined or aggregated likewise. Each rule's
rows are written once to the scratch folder, so the plan of the next rule does not grow.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import code
from freshet.functions.errors import Defer
from freshet.operators.propagation import ran_later, with_upstream
from freshet.operators.store import places
from freshet.plans.model import Pipeline, Rule, task_frame
from freshet.sources.matrix import is_deferrable
from freshet.sources.outputs import with_completeness
from freshet.sources.scratch import durable
from freshet.sources.state import FAILED, SUCCESS, StateStore

log = logging.getLogger("freshet")
REASON = "array<struct<category:string,message:string>>"


@dataclass
class Plan:
    """``tasks``: all known tasks with their record, ``will_run`` and ``reasons``; ``deferred``: rules that must wait."""

    tasks: DataFrame | None
    deferred: list[Rule]
    by_rule: dict[Rule, DataFrame]

    def runnable(self) -> DataFrame | None:
        """The tasks to run, by rule and place in the matrix."""
        return None if self.tasks is None else self.tasks.where("will_run").orderBy("topo", "ord")


    def placed(self) -> DataFrame | None:
        """The tasks to run with their ``place``, from 1."""
        return None if self.tasks is None else places(self.tasks.where("will_run"), "topo", ["ord"])


def versions(tasks: DataFrame) -> DataFrame:
    """The distinct versions of code, declarations and specs among recorded tasks."""
    return tasks.where("status is not null").select("run_code_id", "uses_code_id", "io_code_id").distinct()


def _reason(flag: Column, category: str, message: Column | str) -> Column:
    made = F.struct(F.lit(category).alias("category"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    return F.when(flag, made)


def _ids(found: list, column: str, test) -> tuple[list, bool]:
    """The distinct recorded ids that pass, and whether a missing id does."""
    ids = {r[column] for r in found}
    return [i for i in ids if i is not None and test(i)], None in ids and test(None)


def _among(column: str, passed: tuple[list, bool]) -> Column:
    ids, null = passed
    return F.when(F.col(column).isNull(), F.lit(null)).otherwise(F.col(column).isin(ids) if ids else F.lit(False))


def plan(spark: SparkSession, pipeline: Pipeline, store: StateStore, query: str | None = None, force: bool = False, ignore_code_changes: bool = False) -> Plan:
    began = time.perf_counter()
    deferred: list[Rule] = []
    done: dict[Rule, DataFrame] = {}
    reruns: dict[Rule, bool] = {}
    for topo, rule in enumerate(pipeline.order):
        if any(d in deferred for d in rule.depends_on) or is_deferrable(rule.matrix) and any(reruns.get(d) for d in rule.depends_on):
            deferred.append(rule)
            continue
        try:
            tasks = task_frame(spark, rule, topo, query)
        except Defer:
            deferred.append(rule)
            continue
        if pipeline.check_outputs == "never":
            tasks = tasks.withColumns({"complete": F.lit(None).cast("boolean"), "outputs": F.lit(None).cast("long")})
        else:
            tasks = with_completeness(tasks, rule.outputs)
        known = tasks.join(store.records(spark, rule.name).drop("rule"), "key", "left")
        done[rule] = durable(_judged(known, rule, done, store, pipeline.check_outputs, force, ignore_code_changes), f"plan-{rule.name}")
        reruns[rule] = not done[rule].where("will_run").isEmpty()
    tasks = None
    for frame in done.values():
        tasks = frame if tasks is None else tasks.unionByName(frame)
    log.debug("planned %d rules, %d deferred", len(done), len(deferred), extra={"bound": {"event": "plan", "n": len(done), "seconds": round(time.perf_counter() - began, 6)}})
    return Plan(tasks, deferred, done)


def _judged(tasks: DataFrame, rule: Rule, done: dict[Rule, DataFrame], store: StateStore, check: str, force: bool, ignore: bool) -> DataFrame:
    never, ok = F.col("status").isNull(), F.col("status") == SUCCESS
    adopted = never & F.coalesce("complete", F.lit(False)) if check in ("fallback", "always") else F.lit(False)
    state = F.when(F.col("status") == FAILED, "failed").otherwise("pending")
    unfinished = F.struct(F.concat(F.lit("last-run-"), state).alias("category"), F.concat(F.lit("last run "), state, F.lit(" at "), F.coalesce("ts", F.lit("?"))).alias("message"))
    reasons = [
        _reason(adopted, "adopted-outputs", "never recorded, but all outputs are complete"),
        _reason(never & ~adopted, "never-run", "never run"),
        F.when(~never & ~ok, unfinished),
    ]
    own = (never & ~adopted) | (~never & ~ok)

    if not force and not ignore:
        seen = versions(tasks).collect()
        texts = store.text({i for r in seen for i in r})
        current = {"run_code_id": rule.source, "uses_code_id": code.uses_text(rule.uses), "io_code_id": code.io_text(rule.inputs, rule.outputs)}
        same = {
            "run_code_id": lambda i: code.same_code(texts.get(i, ""), current["run_code_id"]),
            "uses_code_id": lambda i: texts.get(i, "") == current["uses_code_id"],
            "io_code_id": lambda i: i is None or texts.get(i) == current["io_code_id"],  # not tracked: no reason
        }
        explain = {
            "run_code_id": lambda i: f"run code changed since last run:\n{code.diff(texts.get(i, ''), current['run_code_id'])}",
            "uses_code_id": lambda i: code.uses_change(texts.get(i, ""), rule.uses, store.manifest(i) if i is not None else {}),
            "io_code_id": lambda i: code.io_change(texts.get(i, ""), current["io_code_id"]),
        }
        for column, category in (("run_code_id", "code-changed"), ("uses_code_id", "uses-changed"), ("io_code_id", "io-changed")):
            passed = _ids(seen, column, same[column])
            changed = ~never & ~_among(column, passed)
            others = {i for i in (r[column] for r in seen) if not same[column](i)}
            message = F.lit(explain[column](None)) if None in others else F.lit(category)
            for i in others - {None}:
                message = F.when(F.col(column) == i, F.lit(explain[column](i))).otherwise(message)
            reasons.append(_reason(changed, category, message))
            own = own | (ok & changed)
    if check == "always":
        missing = ~never & (F.col("outputs") > 0) & ~F.col("complete")
        reasons.append(_reason(missing, "outputs-missing", "outputs are missing or incomplete"))
        own = own | (ok & missing)

    # upstream: which reruns in this plan, and which ran after this task
    clock, above, n = F.lit(None).cast("long"), F.lit(False), 0
    for dep in rule.depends_on:
        upstream, n = done[dep], n + 1
        tasks = with_upstream(tasks, upstream, rule.elementwise(dep), [F.bool_or("will_run").alias(f"up{n}"), F.max("run_seq").alias(f"seq{n}")])
        here = F.coalesce(F.col(f"up{n}"), F.lit(False))
        told = f"upstream {dep.name} reruns (same kwargs)" if rule.elementwise(dep) else f"tasks of upstream {dep.name} rerun (other matrix: all downstream tasks)"
        reasons.append(_reason(here, "upstream-rerun", told))
        above, clock = above | here, F.greatest(clock, F.col(f"seq{n}")) if n > 1 else F.col(f"seq{n}")
    newer = ~never & ran_later(clock, F.col("run_seq")) & ~above
    reasons.append(_reason(newer, "upstream-newer", "an upstream task ran more recently"))
    will = F.lit(True) if force else own | above | newer
    listed = F.filter(F.array(*reasons), lambda r: r.isNotNull()).cast(REASON)
    return tasks.select("rule", "topo", "ord", "kw", "kw_id", "key", "complete", "outputs", *[c for c in tasks.columns if c in ("status", "ts", "run_code_id", "uses_code_id", "io_code_id", "run_seq", "exception", "wall_s", "cpu_s", "max_rss_bytes", "rss_method")], F.coalesce(will, F.lit(False)).alias("will_run"), listed.alias("reasons"))


def cascade(spark: SparkSession, pipeline: Pipeline, known: dict[Rule, DataFrame], selected: DataFrame) -> DataFrame:
    """The successful tasks downstream of settled ones that are stamped along with them: those without an unsettled upstream
    task that ran later (an unknown own clock counts as older). ``selected``: rule, kw_id; the result likewise."""
    settled = durable(selected.select("rule", "kw_id").distinct(), "settled")
    for rule in pipeline.order:
        if rule not in known or not rule.depends_on:
            continue
        own = known[rule].where(F.col("status") == SUCCESS).select("rule", "kw_id", "run_seq").join(settled, ["rule", "kw_id"], "left_anti")
        good, bad, n = F.lit(False), F.lit(False), 0
        for dep in (d for d in rule.depends_on if d in known):
            n += 1
            up = known[dep].select("rule", "kw_id", F.col("run_seq").alias("seq")).join(settled.withColumn("in", F.lit(True)), ["rule", "kw_id"], "left")
            facts = [F.bool_or(F.coalesce("in", F.lit(False))).alias(f"in{n}"), F.max(F.when(F.col("in").isNull(), F.col("seq"))).alias(f"seq{n}")]
            own = with_upstream(own, up, rule.elementwise(dep), facts)
            good = good | F.coalesce(F.col(f"in{n}"), F.lit(False))
            bad = bad | F.coalesce(F.col(f"seq{n}") > F.col("run_seq"), F.col(f"seq{n}").isNotNull())
        settled = durable(settled.unionByName(own.where(good & ~bad).select("rule", "kw_id")), "settled")
    return settled
