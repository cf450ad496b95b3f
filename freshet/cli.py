"""Commands over a pipeline file. Exit codes: 0, 1 (tasks failed or lint found something), 2 (an error of the user's)."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from freshet.functions.errors import FreshetError
from freshet.plans import execute, report
from freshet.plans.model import CHECKS, load_pipeline
from freshet.sources.files import log_to, task_log
from freshet.sources.state import ParquetStore
from freshet.streaming.ingest import ingest

VERSION = "0.1.0"


def executor(name: str, logs: str, width: int | None = None) -> execute.Executor:
    """local, spark, or ``module:Class`` (or a dotted path) of the user's."""
    if name in ("local", "spark"):
        return execute.LocalExecutor(logs) if name == "local" else execute.SparkExecutor(width, logs)
    module, _, cls = name.partition(":") if ":" in name else name.rpartition(".")
    try:
        found = getattr(importlib.import_module(module), cls) if module else None
    except (ImportError, AttributeError) as e:
        raise FreshetError(f"no executor is called {name}: {e}") from e
    if not (isinstance(found, type) and issubclass(found, execute.Executor)):
        raise FreshetError(f"{name} is no class of executors")
    return found()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="freshet", description="Incremental data pipelines on Spark.")
    commands = p.add_subparsers(dest="command")

    def add(name: str, *options: str):
        c = commands.add_parser(name)
        if name != "version":
            c.add_argument("pipeline")
        for o in options:
            if o in ("query", "key", "executor", "state"):
                c.add_argument(*(["-Q"] if o == "query" else ["-E"] if o == "executor" else []), f"--{o}", default="local" if o == "executor" else None)
            elif o.startswith("name"):
                c.add_argument("name")
            elif o == "nproc":
                c.add_argument("--nproc", type=int, help="partitions over which the tasks of a rule are spread")
            elif o == "check-outputs=":
                c.add_argument("--check-outputs", choices=CHECKS)
            else:
                c.add_argument(f"--{o}", action="store_true")

    add("run", "query", "executor", "nproc", "check-outputs=", "force", "dry-run", "ignore-code-changes", "raise")
    add("run-task", "key", "query")
    add("set-state", "query", "success", "pending", "check-outputs", "no-cascade", "dry-run")
    add("info", "query", "json", "failures")
    add("ls-tasks", "query", "json")
    add("lint", "json")
    add("rule-dag", "json", "matrix")
    add("rule-info", "name", "json")
    add("task-info", "key", "query", "json")
    add("task-log", "key", "query")
    add("why", "key", "query", "json")
    add("ingest")
    add("version")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        parser().print_help()
        return 1
    if args.command == "version":
        print(VERSION)
        return 0
    try:
        return command(args, spark or SparkSession.builder.appName("freshet").getOrCreate())
    except FreshetError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def command(args, spark: SparkSession) -> int:
    pipeline = load_pipeline(args.pipeline)
    home = Path(args.pipeline).resolve().parent / ".freshet"
    store = pipeline.store or ParquetStore(home / "state")
    log_to(home / "logs")
    ingest(spark, home / "results", store, pipeline)
    name = args.command

    def show(value) -> None:
        print(json.dumps(value, indent=2, default=str) if getattr(args, "json", False) or not isinstance(value, list) else "\n".join(" ".join(f"{k}={v}" for k, v in row.items()) for row in value))

    def rows(frame) -> list[dict]:
        return [r.asDict(recursive=True) for r in frame.toLocalIterator()]

    if name in ("run", "run-task"):
        if name == "run-task":
            task = report.find(spark, pipeline, args.key, args.query)
            kw = json.loads(task.kw)
            query = " and ".join([f"rule == {task.rule!r}", *(f"{k} == {v!r}" for k, v in kw.items())])
            done = execute.run(spark, pipeline, store, executor("local", str(home / "tasks")), query=query, force=True)
        else:
            pipeline.check_outputs = args.check_outputs or pipeline.check_outputs
            chosen = executor(args.executor, str(home / "tasks"), args.nproc)
            chosen.raise_on_failure = chosen.raise_on_failure or getattr(args, "raise")
            done = execute.run(spark, pipeline, store, chosen, args.query, args.force, args.ignore_code_changes, args.dry_run)
        show(done)
        return int(done["failed"] > 0)
    if name == "set-state":
        show(report.set_state(spark, pipeline, store, args.query, args.success, args.pending, args.check_outputs, not args.no_cascade, args.dry_run))
    elif name == "info":
        show(report.status(spark, pipeline, store, args.query) | ({"failures": report.failures(spark, pipeline, store)} if args.failures else {}))
    elif name == "ls-tasks":
        show(rows(report.all_tasks(spark, pipeline, args.query).select("rule", "kw", "key").orderBy("key")))
    elif name == "lint":
        found = rows(report.lint(spark, pipeline))
        show(found)
        return int(any(f["kind"] != "external" for f in found))
    elif name == "rule-dag":
        show(report.rule_dag(pipeline, args.matrix))
    elif name == "rule-info":
        show(report.rule_info(pipeline, args.name))
    elif name == "task-info":
        show(report.task_info(spark, pipeline, store, args.key, args.query))
    elif name == "task-log":
        path = task_log(home / "tasks", report.find(spark, pipeline, args.key, args.query).key)
        print(path.read_text() if path.exists() else "the task has no log", end="")
    elif name == "why":
        show(rows(report.why(spark, pipeline, store, args.query, args.key)))
    return 0
