"""Times the headline queries: reads $BENCH_SF_DIR on local[$BENCH_CPUS], prints one JSON line."""

import hashlib
import json
import os
import time

from pyspark.sql import SparkSession

from freshet.plans import catalogue, model, planner, report
from freshet.sources.state import ParquetStore

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The other queries of plans and lint run the same plan or the same lint as those here.
HEADLINE = (
    "matrix_cartesian task_query_filter record_with_tombstone resources_last_exec code_intern rerun_closure cascade_settled"
    " status_partition runnable_order failure_groups lint_order elementwise_proof rule_batches comment_filter daily_mean"
    " normalise_above_threshold seasonal_mean_djf anomaly_vs_reference mean_std pairwise_reduce"
).split()


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def grid_plan(spark: SparkSession, n: int, folder: str) -> tuple[dict[str, float], dict[str, float]]:
    """The reference shape: an n x n grid with one input and one output. Expansion with keys, resolving all paths, plans of an
    empty and of a filled store, a look-up by key, status. Each cold (the first time in this session) and warm."""
    from pyspark.sql import functions as F

    from freshet.sources.state import track

    grid = model.rule(inputs={"x": "in/{a}/{b}"}, outputs={"x": "out/{a}/{b}"}, matrix={"a": list(range(n)), "b": list(range(n))}, name="grid")(lambda inputs, outputs, a, b: None)
    pipeline, store, cold, warm = model.Pipeline([grid]), ParquetStore(folder), {}, {}

    def both(name: str, f) -> None:
        cold[f"{name}_{n * n}"], warm[f"{name}_{n * n}"] = timed(f), timed(f)

    planned = lambda: planner.plan(spark, pipeline, store).tasks.where("will_run").count()
    both("expand", lambda: model.task_frame(spark, grid, 0).agg({"key": "max"}).collect())
    both("resolve", lambda: report.files(spark, pipeline)[0].agg({"path": "max"}).collect())
    both("plan_empty", planned)
    run, uses, io = track(store, grid)
    done = planner.plan(spark, pipeline, store).tasks.select("key", "rule").withColumns({"kind": F.lit("exec"), "status": F.lit(1), "run_code_id": F.lit(run), "uses_code_id": F.lit(uses), "io_code_id": F.lit(io), "run_seq": F.lit(1)})
    both("record", lambda: store.append(done))
    both("plan_filled", planned)
    key = grid.key({"a": n - 1, "b": n - 1})
    both("find_key", lambda: report.find(spark, pipeline, key))
    both("status", lambda: report.status(spark, pipeline, store))
    return cold, warm


def listing(spark: SparkSession, tasks: int, files: int, folder: str) -> tuple[dict[str, float], dict[str, float]]:
    """``tasks`` tasks of ``files`` outputs each, none recorded, every tenth task's outputs there: a plan that looks at all of them."""
    names = {f"f{i}": f"{folder}/{{t}}/{i}" for i in range(files)}
    for t in range(0, tasks, 10):
        os.makedirs(f"{folder}/{t}")
        for i in range(files):
            open(f"{folder}/{t}/{i}", "w").close()
    r = model.rule(outputs=names, matrix={"t": list(range(tasks))}, name="many")(lambda outputs, t: None)
    pipeline, store = model.Pipeline([r], check_outputs="fallback"), ParquetStore(f"{folder}-state")
    look = lambda: planner.plan(spark, pipeline, store).tasks.where("will_run").count()
    name = f"plan_fallback_{tasks * files}"
    return {name: timed(look)}, {name: timed(look)}


def results(spark: SparkSession, n: int, folder: str) -> dict[str, float]:
    """Taking in the results of n tasks that ran elsewhere."""
    from freshet.streaming.ingest import ingest, write_result

    for i in range(n):
        write_result(f"{folder}/results", hashlib.sha1(str(i).encode()).hexdigest(), rule="r", status=1, run_seq=1, timestamp="2024-01-01 00:00:00", run_hash="x", uses_hash="", io_hash="y")
    store = ParquetStore(f"{folder}/state")
    return {f"ingest_{n}": timed(lambda: ingest(spark, f"{folder}/results", store))}


def main() -> None:
    import tempfile

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, each = catalogue.queries(), {}
    for name in HEADLINE:
        run = lambda: found[name](spark, SF).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()  # warm: code is compiled, files are known
        each[name] = round(timed(run), 3)
    with tempfile.TemporaryDirectory() as folder:
        cold: dict[str, float] = {}
        for first, again in (grid_plan(spark, 1000, f"{folder}/a"), grid_plan(spark, 100, f"{folder}/b"), listing(spark, 10_000, 100, f"{folder}/c")):
            cold |= {k: round(v, 3) for k, v in first.items()}
            each |= {k: round(v, 3) for k, v in again.items()}
        for n in (800, 1600):
            each |= {k: round(v, 3) for k, v in results(spark, n, f"{folder}/r{n}").items()}
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(each.values()), 3), "unit": "sec", "queries": each, "cold": cold, "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
