"""What the commands tell: status, reasons, failures, lint, lineage, single tasks and rules, set-state."""

from __future__ import annotations

import functools
import json
import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.errors import Defer, FreshetError, LookupFailed
from freshet.operators import reports
from freshet.plans.model import Pipeline, Rule, path_frame, task_frame
from freshet.plans.planner import Plan, cascade, plan
from freshet.sources import matrix as grids
from freshet.sources import outputs
from freshet.sources.scratch import durable
from freshet.sources.state import FAILED, SUCCESS, StateStore, track

log = logging.getLogger("freshet")


def state_counts(made: Plan) -> DataFrame:
    """For each rule, and for all together (``rule`` null), the four states that partition the tasks, and the number to run."""
    # a pending task that the plan leaves out was adopted: it is up to date
    named = F.when(F.col("status") == FAILED, "failed").when(F.col("status") == SUCCESS, "success").when(~F.col("will_run"), "success").otherwise("pending")
    return reports.status_partition(made.tasks.withColumn("state", named), "rule", "state", "will_run", totals=True)


def reason_counts(made: Plan) -> DataFrame:
    return reports.reason_tally(made.tasks.where("will_run").withColumn("why", F.col("reasons.category")), "rule", "why")


def status(spark: SparkSession, pipeline: Pipeline, store: StateStore, query: str | None = None) -> dict:
    """For each rule the four states that partition its tasks, the number to run, and why; and totals."""
    made = plan(spark, pipeline, store, query)
    rows, why = {}, {}
    if made.tasks is not None:
        rows = {r.rule: r.asDict() for r in state_counts(made).collect()}
        for r in reason_counts(made).collect():
            why.setdefault(r.rule, {})[r.category] = r.n
    nothing = dict.fromkeys(("tasks", "up_to_date", "stale", "failed", "pending", "to_run"), 0)
    listed = [{"rule": r.name, "deferred": True} if r in made.deferred else {"deferred": False, "reasons": why.get(r.name, {})} | rows.get(r.name, {"rule": r.name} | nothing) for r in pipeline.order]
    return {"rules": listed, "totals": {n: rows.get(None, nothing)[n] for n in nothing}}


def failed_members(spark: SparkSession, store: StateStore) -> DataFrame:
    """Every failed task with the signature of its group: ``type``, ``place``, ``first_seen``, ``key``, ``at``."""
    failed = store.records(spark).where("status = 2").withColumn("at", F.struct("event_seq", "key"))
    return reports.failure_members(failed, "at", "exception", "key")


def failures(spark: SparkSession, pipeline: Pipeline, store: StateStore) -> list[dict]:
    """Failed tasks grouped by exception type and frames, first seen first."""
    failed = store.records(spark).where("status = 2").withColumn("at", F.struct("event_seq", "key"))
    return [r.asDict() for r in reports.failure_groups(failed, "at", "exception", "key").orderBy("first_seen").drop("first_seen").collect()]


def all_tasks(spark: SparkSession, pipeline: Pipeline, query: str | None = None) -> DataFrame:
    """All tasks that can be expanded; deferred rules are left out with a warning."""
    out = None
    for topo, rule in enumerate(pipeline.order):
        try:
            frame = task_frame(spark, rule, topo, query=query)
        except Defer:
            log.warning("%s: matrix not ready, left out", rule.name)
            continue
        out = frame if out is None else out.unionByName(frame)
    if out is None:
        raise FreshetError("no rule can be expanded")
    return out


def with_prefix(tasks: DataFrame, prefix: str) -> DataFrame:
    return tasks.where(F.col("key").startswith(prefix))


def find(spark: SparkSession, pipeline: Pipeline, key: str | None = None, query: str | None = None):
    """The one task with a key or prefix of a key, or that a query selects."""
    if bool(key) == bool(query):
        raise LookupFailed("give a key or a query, and not both")
    tasks = all_tasks(spark, pipeline, query)
    hits = (with_prefix(tasks, key) if key else tasks).limit(2).collect()
    if len(hits) != 1:
        raise LookupFailed(f"{'no task matches' if not hits else 'several tasks match'} {key or query!r}")
    return hits[0]


def why(spark: SparkSession, pipeline: Pipeline, store: StateStore, query: str | None = None, key: str | None = None) -> DataFrame:
    """``rule``, ``kw``, ``key``, ``will_run``, ``reasons`` of the tasks asked for; one plan serves all."""
    tasks = plan(spark, pipeline, store).tasks
    if key:
        tasks = with_prefix(tasks, key)
    if query:
        wanted = all_tasks(spark, pipeline, query).select("key")
        tasks = tasks.join(wanted, "key", "left_semi")
    return tasks.select("rule", "kw", "key", "will_run", "reasons")


def _paths(tasks: DataFrame, rule: Rule) -> DataFrame:
    """The same for one rule whose specs only Python can render: on the executors."""
    name, specs = rule.name, {"in": rule.inputs, "out": rule.outputs}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, part, str(v)) for kw in batch.column(0).to_pylist() for part, spec in specs.items() for v in outputs.resolve(spec, json.loads(kw)).values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 3)], ["rule", "part", "path"])

    return tasks.select("kw").mapInArrow(emit, "rule string, part string, path string")


def files(spark: SparkSession, pipeline: Pipeline) -> tuple[DataFrame, list[Rule]]:
    """``rule``, ``part`` (in, out), ``path`` of all tasks; and the rules whose matrix is not ready."""
    waiting, frames = [], []
    for rule in pipeline.rules:
        frame = path_frame(spark, rule)
        if frame is not None:
            frames.append(frame.select(F.lit(rule.name).alias("rule"), "part", "path"))
            continue
        try:
            frames.append(_paths(task_frame(spark, rule, 0), rule))
        except Defer:
            log.warning("%s: matrix not ready, left out", rule.name)
            waiting.append(rule)
    found = spark.createDataFrame([], "rule string, part string, path string")
    for frame in frames:
        found = found.unionByName(frame)
    return found, waiting


def lint(spark: SparkSession, pipeline: Pipeline) -> DataFrame:
    """Inputs that none of a rule's dependencies gives: ``kind`` (near_miss, missing_dependency, external), ``rule``,
    ``other_rule``, ``n``, ``example``, ``closest``; near misses first."""
    found, waiting = files(spark, pipeline)
    found = durable(found, "files")
    checked = [r for r in pipeline.rules if r.inputs is not None and r not in waiting and not any(d in waiting for d in r.depends_on)]
    makers = found.where("part = 'out'").select("path", F.col("rule").alias("maker")).distinct()
    names = [r.name for r in checked]
    inputs = found.where("part = 'in'").where(F.col("rule").isin(names)).groupBy("rule", "path").agg(F.count("*").alias("n"))
    declared = spark.createDataFrame([(r.name, d.name) for r in checked for d in [r, *r.depends_on]], "rule string, maker string")
    made = inputs.join(makers, "path")
    fine = made.join(declared, ["rule", "maker"], "left_semi").select("rule", "path")
    undeclared = made.join(fine, ["rule", "path"], "left_anti").groupBy("rule", "path", "n").agg(F.min("maker").alias("other_rule")).withColumn("kind", F.lit("missing_dependency"))
    lost = inputs.join(makers.select("path").distinct(), "path", "left_anti")
    upstream = spark.createDataFrame([(r.name, d.name) for r in checked for d in r.depends_on], "rule string, maker string")
    close = None
    for r in checked:
        if r.depends_on:
            known = makers.join(upstream.where(F.col("rule") == r.name), "maker").select("path", "maker")
            near = reports.near_misses(lost.where(F.col("rule") == r.name).select("path").distinct(), known.select("path").distinct()).withColumn("rule", F.lit(r.name))
            near = near.join(makers.select(F.col("path").alias("suggestion"), "maker").groupBy("suggestion").agg(F.min("maker").alias("other_rule")), "suggestion")
            close = near if close is None else close.unionByName(near)
    shape = ["kind", "rule", "other_rule", "path", "n", "closest"]
    close = (close if close is not None else spark.createDataFrame([], "suggestion string, path string, ratio double, rule string, other_rule string")).join(lost, ["rule", "path"]).select(F.lit("near_miss").alias("kind"), "rule", "other_rule", "path", "n", F.col("suggestion").alias("closest"))
    external = lost.join(close.select("rule", "path"), ["rule", "path"], "left_anti").select(F.lit("external").alias("kind"), "rule", F.lit(None).cast("string").alias("other_rule"), "path", "n", F.lit(None).cast("string").alias("closest"))
    all_ = close.unionByName(undeclared.withColumn("closest", F.lit(None).cast("string")).select(*shape)).unionByName(external)
    grouped = all_.groupBy("kind", "rule", "other_rule").agg(F.sum("n").alias("n"), F.min("path").alias("example"), F.min_by("closest", "path").alias("closest"))
    return grouped.orderBy(F.col("kind") != "near_miss", "kind", "rule", F.coalesce("other_rule", F.lit("")))


def rule_dag(pipeline: Pipeline, with_matrix: bool = False) -> dict:
    out = {"order": [r.name for r in pipeline.order], "edges": {r.name: [s.name for s in pipeline.order if r in s.depends_on] for r in pipeline.order}}
    if with_matrix:
        out["matrix"] = {}
        for r in pipeline.order:
            try:
                grid = r.grid()
                out["matrix"][r.name] = [grid.size(), sorted(grid.names)]
            except Defer:
                out["matrix"][r.name] = [None, None]
    return out


def depths(pipeline: Pipeline) -> dict[str, int]:
    """How many rules lie above each, on the longest way."""
    out: dict[str, int] = {}
    for r in pipeline.order:
        out[r.name] = max((out[d.name] + 1 for d in r.depends_on), default=0)
    return out


def rule_info(pipeline: Pipeline, name: str) -> dict:
    r = pipeline[name]
    names = None if callable(r.matrix) else grids.parsed(r.matrix, r.name).names
    try:
        n = r.grid().size()
    except Defer:
        n = None
    spec = lambda s: None if s is None else "function" if callable(s) else {k: str(v) for k, v in s.items()}
    return {"rule": r.name, "doc": r.fn.__doc__, "depends_on": [d.name for d in r.depends_on], "needed_by": [s.name for s in pipeline.order if r in s.depends_on], "matrix": "function" if names is None else type(r.matrix).__name__, "kwargs": sorted(names or ()), "tasks": n, "inputs": spec(r.inputs), "outputs": spec(r.outputs), "uses": sorted(r.uses), "config": r.config}


def task_info(spark: SparkSession, pipeline: Pipeline, store: StateStore, key: str | None = None, query: str | None = None) -> dict:
    """A task's record and paths; an input that is no path is shown as it is."""
    task = find(spark, pipeline, key, query)
    rule, kwargs = pipeline[task.rule], json.loads(task.kw)
    record = store.records(spark).where(F.col("key") == task.key).first()
    there = lambda v: outputs.holds(v if isinstance(v, outputs.Output) else outputs.Output(str(v)))
    inputs = {k: {"value": str(v), "exists": there(v) if isinstance(v, (str, outputs.Output)) else None} for k, v in outputs.resolve(rule.inputs, kwargs).items()}
    made = {k: {"value": str(x), "complete": there(x)} for k, x in outputs.outputs_for(rule.outputs, kwargs).items()}
    return {"rule": task.rule, "kwargs": kwargs, "key": task.key, "record": record and record.asDict(), "inputs": inputs, "outputs": made}


#: Options of set-state that do not go together.
SET_STATE_CLASHES = {
    "one of success and pending": lambda o: o["success"] == o["pending"],
    "a look at outputs, or a cascade that is left out, with success only": lambda o: o["pending"] and (o["check_outputs"] or not o["with_downstream"]),
}


def set_state(spark: SparkSession, pipeline: Pipeline, store: StateStore, query: str, success: bool = False, pending: bool = False, check_outputs: bool = False, with_downstream: bool = True, dry_run: bool = False) -> dict:
    """Record tasks as successful without running them (and, downstream, what would only look stale by it), or forget them.
    The tasks are relations throughout; only numbers come to the driver."""
    options = {"success": success, "pending": pending, "check_outputs": check_outputs, "with_downstream": with_downstream}
    for asked, clashes in SET_STATE_CLASHES.items():
        if clashes(options):
            raise FreshetError(f"set-state takes {asked}")
    tasks = durable(all_tasks(spark, pipeline, query).select("rule", "kw", "kw_id", "key"), "chosen")
    picked = tasks
    if check_outputs:
        made = [outputs.with_completeness(tasks.where(F.col("rule") == r.name), r.outputs).where("complete") for r in pipeline.order]
        picked = durable(functools.reduce(DataFrame.unionByName, made).select(*tasks.columns), "complete")
    n = picked.count()
    told = {"state": "success" if success else "pending", "tasks": n, "cascaded": 0, "skipped": tasks.count() - n}
    events = picked.select("key", "rule", F.lit("delete").alias("kind"))
    if success:
        if with_downstream:
            known = plan(spark, pipeline, store)
            settled = cascade(spark, pipeline, known.by_rule, picked)
            more = durable(known.tasks.join(settled, ["rule", "kw_id"], "left_semi").join(picked, "key", "left_anti").select(*tasks.columns), "cascaded")
            told["cascaded"] = more.count()
            picked = picked.unionByName(more)
        events = None if dry_run else _successes(spark, pipeline, store, picked)
    if not dry_run:
        store.append(events)
    return told


def _successes(spark: SparkSession, pipeline: Pipeline, store: StateStore, tasks: DataFrame) -> DataFrame:
    """Events that stamp ``tasks`` with the present code and a new value of the clock."""
    from freshet.plans.execute import now

    stamp = {"kind": F.lit("state"), "status": F.lit(SUCCESS), "ts": F.lit(now()), "run_seq": F.lit(store.begin()), "exception": F.lit("")}
    ids = spark.createDataFrame([(r.name, *track(store, r)) for r in pipeline.rules], "rule string, run_code_id long, uses_code_id long, io_code_id long")
    return tasks.select("key", "rule").join(F.broadcast(ids), "rule").withColumns(stamp)
