"""Running the stale tasks: waves of plans, rule by rule, on the driver or as a Spark job for each rule."""

from __future__ import annotations

import contextlib
import json
import logging
import os
import resource
import threading
import time
import traceback
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.code import Bound
from freshet.operators.propagation import not_tainted
from freshet.plans.model import Pipeline, Rule
from freshet.plans.planner import plan
from freshet.sources.files import to_task_log
from freshet.sources.outputs import outputs_for, resolve
from freshet.sources.state import FAILED, SUCCESS, StateStore, track

log = logging.getLogger("freshet")
RESULT = "key string, kw_id string, status int, ts string, exception string, wall_s double, cpu_s double, max_rss_bytes long, rss_method string"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


#: Seconds between two looks at a task's memory: if nothing usable is given, and the least.
SAMPLE_SECONDS, LEAST_SECONDS = 0.05, 0.01


def sampling_interval(given) -> float:
    """Seconds from a rule's ``config["sample_seconds"]``; what is no positive number counts as not given."""
    try:
        seconds = float(given)
    except (TypeError, ValueError):
        return SAMPLE_SECONDS
    return max(LEAST_SECONDS, seconds) if 0 < seconds < float("inf") else SAMPLE_SECONDS


class MemorySampler(threading.Thread):
    """The most memory that the process had while a task ran: looked at now and then, at the start and at the end."""

    def __init__(self, every=None):
        super().__init__(daemon=True)
        self.every, self.over, self.peak = sampling_interval(every), threading.Event(), 0

    def look(self) -> None:
        with contextlib.suppress(OSError, IndexError, ValueError):
            with open("/proc/self/statm") as f:
                self.peak = max(self.peak, int(f.read().split()[1]) * resource.getpagesize())

    def run(self) -> None:
        self.look()
        while not self.over.wait(self.every):
            self.look()

    def finish(self) -> tuple[int, str]:
        """(bytes, how they were found); where there is nothing to sample, the process's peak since it started."""
        self.look()
        self.over.set()
        self.join()
        return (self.peak, "sampled") if self.peak else (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024, "process-peak")


def run_task(fn: Callable, inputs, outputs, kwargs: dict, every=None) -> dict:
    """Run one task and say how it went. Parent folders of path outputs are made first; an error is a result, so Spark does
    not retry a task that failed; whether outputs are complete afterwards is not looked at."""
    began, cpu = time.perf_counter(), time.process_time()
    status, error, sampler = SUCCESS, "", MemorySampler(every)
    sampler.start()
    try:
        args = []
        if inputs is not None:
            args.append(resolve(inputs, kwargs))
        if outputs is not None:
            made = outputs_for(outputs, kwargs)
            for x in made.values():
                if x.check is None and "://" not in x.path:
                    os.makedirs(os.path.dirname(x.path) or ".", exist_ok=True)
            args.append({name: x.path for name, x in made.items()})
        fn(*args, **kwargs)
    except Exception:  # noqa: BLE001  the task's own failure
        status, error = FAILED, traceback.format_exc()
    peak, method = sampler.finish()
    return {"status": status, "ts": now(), "exception": error, "wall_s": round(time.perf_counter() - began, 6), "cpu_s": round(time.process_time() - cpu, 6), "max_rss_bytes": peak, "rss_method": method}


class Executor(ABC):
    """Runs the tasks of one rule; gives results in the form RESULT."""

    raise_on_failure = False
    supports_dry_run = True

    @abstractmethod
    def run_rule(self, spark: SparkSession, rule: Rule, tasks: DataFrame) -> DataFrame: ...


class LocalExecutor(Executor):
    """One task after the other in the driver's process; what a task prints goes to a log of its own, if ``logs`` is a folder."""

    def __init__(self, logs: str | None = None):
        self.logs = logs

    def run_rule(self, spark: SparkSession, rule: Rule, tasks: DataFrame) -> DataFrame:
        fn = Bound(rule.fn, rule.uses)
        results = []
        for t in tasks.orderBy("ord").toLocalIterator():
            with to_task_log(self.logs, t.key):
                r = run_task(fn, rule.inputs, rule.outputs, json.loads(t.kw), rule.config.get("sample_seconds"))
            results.append((t.key, t.kw_id, r["status"], r["ts"], r["exception"], r["wall_s"], r["cpu_s"], r["max_rss_bytes"], r["rss_method"]))
        return spark.createDataFrame(results, RESULT)


class SparkExecutor(Executor):
    """One Spark job for each rule; the tasks are spread over ``width`` partitions. A task may be run again if its executor is
    lost, so rule functions should write by renaming or overwrite their outputs."""

    def __init__(self, width: int | None = None, logs: str | None = None):
        self.width, self.logs = width, logs

    def run_rule(self, spark: SparkSession, rule: Rule, tasks: DataFrame) -> DataFrame:
        fn, inputs, outputs, logs, every = Bound(rule.fn, rule.uses), rule.inputs, rule.outputs, self.logs, rule.config.get("sample_seconds")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    with to_task_log(logs, row["key"]):
                        result = run_task(fn, inputs, outputs, json.loads(row["kw"]), every)
                    yield pa.RecordBatch.from_pylist([{"key": row["key"], "kw_id": row["kw_id"]} | result], pa.schema([("key", pa.string()), ("kw_id", pa.string()), ("status", pa.int32()), ("ts", pa.string()), ("exception", pa.string()), ("wall_s", pa.float64()), ("cpu_s", pa.float64()), ("max_rss_bytes", pa.int64()), ("rss_method", pa.string())]))

        width = self.width or spark.sparkContext.defaultParallelism
        return tasks.select("key", "kw_id", "kw").repartition(width).mapInArrow(work, RESULT)


def run(spark: SparkSession, pipeline: Pipeline, store: StateStore, executor: Executor | None = None, query: str | None = None, force: bool = False, ignore_code_changes: bool = False, dry_run: bool = False) -> dict:
    """Plan and run until nothing more can be: deferred rules are planned again after each wave. A task is tried once; tasks
    whose upstream failed in this run are left out and stay as they were. Gives the numbers run, failed and left out."""
    executor = executor or LocalExecutor()
    seq = store.begin() if not dry_run else None
    attempted: DataFrame | None = None
    total = {"run": 0, "failed": 0, "skipped": 0, "deferred": []}
    failures: dict[Rule, DataFrame] = {}
    first = True
    while True:
        made = plan(spark, pipeline, store, query, force and first, ignore_code_changes)
        first = False
        wave = None if made.tasks is None else made.tasks.where("will_run")
        if wave is not None and attempted is not None:
            wave = wave.join(attempted, "key", "left_anti")
        total["deferred"] = [r.name for r in made.deferred]
        if wave is None or wave.isEmpty():
            return total
        if dry_run:
            return total | {"run": wave.count()}
        tried = wave.select("key")
        for rule in pipeline.order:
            own = wave.where(F.col("rule") == rule.name)
            n = own.count()
            if not n:
                continue
            for dep in rule.depends_on:
                if dep in failures:
                    own = not_tainted(own, failures[dep], rule.elementwise(dep))
            here = own.count()
            if here < n:
                total["skipped"] += n - here
                lost = wave.where(F.col("rule") == rule.name).join(own.select("key"), "key", "left_anti").select("kw_id")
                failures[rule] = lost if rule not in failures else failures[rule].union(lost)
            if not here:
                continue
            run_id, uses_id, io_id = track(store, rule)
            results = executor.run_rule(spark, rule, own)
            marked = results.withColumns({"rule": F.lit(rule.name), "kind": F.lit("exec"), "run_code_id": F.lit(run_id), "uses_code_id": F.lit(uses_id), "io_code_id": F.lit(io_id), "run_seq": F.lit(seq)})
            states = store.append(marked)  # the only action over the results: each task runs once
            bad = own.select("key", "kw_id").join(states.where(F.col("status") == FAILED).select("key"), "key", "left_semi").select("kw_id")
            failed = bad.count()
            log.info("%s: %d tasks ran, %d failed", rule.name, here, failed, extra={"bound": {"event": "rule", "rule": rule.name, "n": here}})
            total["run"] += here
            total["failed"] += failed
            if failed:
                failures[rule] = bad if rule not in failures else failures[rule].union(bad)
                if executor.raise_on_failure:
                    raise RuntimeError(f"{failed} tasks of {rule.name} failed")
        attempted = tried if attempted is None else attempted.union(tried)
