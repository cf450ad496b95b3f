"""Pipelines end to end: triggers, propagation, deferral, failures, set-state, lint, commands."""

import json

import pytest

from freshet import Defer, LookupFailed, Output, ParquetStore, Pipeline, SignatureError, SparkExecutor, deferrable, plan, rule, run
from freshet.cli import main
from freshet.functions import code
from freshet.plans import report
from freshet.sources import files
from freshet.sources.outputs import array_store, spark_table, with_completeness
from freshet.plans.model import Rule, kwargs_id, task_frame, task_key
from freshet.sources.matrix import rows_of
from freshet.streaming.ingest import ingest, ingest_stream, write_result, write_spec


def chain(d, scale=2):
    """generate[year x 3] -> process (same matrix) -> combine."""
    years = {"year": [2000, 2001, 2002]}

    def generate(outputs, year):
        open(outputs["x"], "w").write(str(year))

    def process(inputs, outputs, year):
        open(outputs["x"], "w").write(str(int(open(inputs["x"]).read()) * scale))  # noqa: F821

    def combine(inputs, outputs):
        open(outputs["x"], "w").write(str(sum(int(open(p).read()) for p in inputs.values())))

    generate = rule(outputs={"x": f"{d}/a/{{year}}"}, matrix=years)(generate)
    process = rule(inputs={"x": f"{d}/a/{{year}}"}, outputs={"x": f"{d}/b/{{year}}"}, matrix=years, depends_on=[generate], uses={"scale": scale})(process)
    combine = rule(inputs={str(y): f"{d}/b/{y}" for y in years["year"]}, outputs={"x": f"{d}/c"}, depends_on=[process])(combine)
    return Pipeline([generate, process, combine])


def planned(spark, p, store, **more):
    made = plan(spark, p, store, **more)
    return {(r.rule, r.kw): [x.category for x in r.reasons] for r in made.runnable().collect()}


def test_run_then_nothing_then_change(spark, tmp_path):
    store = ParquetStore(tmp_path / "s")
    p = chain(tmp_path)
    assert run(spark, p, store)["run"] == 7
    assert (tmp_path / "c").read_text() == "12006"
    assert planned(spark, p, store) == {}
    changed = planned(spark, chain(tmp_path, 3), store)
    assert {k[0] for k in changed} == {"process", "combine"} and len(changed) == 4
    assert "uses-changed" in changed["process", '{"year": 2000}'] and changed["combine", "{}"] == ["upstream-rerun"]
    assert planned(spark, chain(tmp_path, 3), store, ignore_code_changes=True) == {}
    done = run(spark, chain(tmp_path, 3), store, SparkExecutor(2))
    assert done["run"] == 4 and (tmp_path / "c").read_text() == "18009"


def test_partial_run_makes_downstream_stale_by_clock(spark, tmp_path):
    store, p = ParquetStore(tmp_path / "s"), chain(tmp_path)
    run(spark, p, store)
    run(spark, p, store, query="rule == 'generate' and year == 2001", force=True)
    assert planned(spark, p, store) == {("process", '{"year": 2001}'): ["upstream-newer"], ("combine", "{}"): ["upstream-rerun"]}
    got = report.set_state(spark, p, store, "rule == 'generate' and year == 2001", success=True)
    assert got["tasks"] == 1 and got["cascaded"] == 2  # process[2001] and combine
    assert planned(spark, p, store) == {}
    report.set_state(spark, p, store, "rule == 'combine'", pending=True)
    assert planned(spark, p, store) == {("combine", "{}"): ["never-run"]}


def test_diamond_cascade_is_guarded(spark, tmp_path):
    up1, up2 = (rule(name=n)(lambda: None) for n in ("up1", "up2"))
    down = rule(name="down", depends_on=[up1, up2])(lambda: None)
    tail = rule(name="tail", depends_on=[down])(lambda: None)
    p, store = Pipeline([up1, up2, down, tail]), ParquetStore(tmp_path / "s")
    run(spark, p, store)
    run(spark, p, store, query="rule == 'up2'", force=True)
    assert report.set_state(spark, p, store, "rule == 'up1'", success=True)["cascaded"] == 0  # up2 is independently newer
    assert {k[0] for k in planned(spark, p, store)} == {"down", "tail"}


def test_failures_taint_downstream_and_are_grouped(spark, tmp_path):
    grid = {"n": [0, 1, 2]}

    def a(n):
        if n != 0:
            raise ValueError(f"bad {n}")

    a = rule(matrix=grid)(a)
    b = rule(matrix=grid, depends_on=[a], name="b")(lambda n: None)
    c = rule(depends_on=[b], name="c")(lambda: None)
    p, store = Pipeline([a, b, c]), ParquetStore(tmp_path / "s")
    done = run(spark, p, store)
    assert (done["run"], done["failed"], done["skipped"]) == (4, 2, 3)
    groups = report.failures(spark, p, store)
    assert len(groups) == 1 and groups[0]["n"] == 2 and groups[0]["type"] == "ValueError"
    info = report.status(spark, p, store)
    assert info["totals"] == {"tasks": 7, "up_to_date": 2, "stale": 0, "failed": 2, "pending": 3, "to_run": 5}
    assert info["rules"][0]["reasons"] == {"last-run-failed": 2}


def test_deferred_matrix(spark, tmp_path):
    found = tmp_path / "found.json"

    def find(outputs):
        open(outputs["x"], "w").write(json.dumps(["C1", "C2"]))

    @deferrable
    def ids():
        if not found.exists():
            raise Defer(found)
        return [{"cid": c} for c in json.loads(found.read_text())]

    def each(outputs, cid):
        open(outputs["x"], "w").write(cid)

    find = rule(outputs={"x": str(found)})(find)
    each = rule(outputs={"x": f"{tmp_path}/{{cid}}"}, matrix=ids, depends_on=[find])(each)
    last = rule(depends_on=[each], name="last")(lambda: None)
    p, store = Pipeline([find, each, last]), ParquetStore(tmp_path / "s")
    assert [r.name for r in plan(spark, p, store).deferred] == ["each", "last"]
    assert run(spark, p, store) == {"run": 4, "failed": 0, "skipped": 0, "deferred": []}
    assert (tmp_path / "C2").read_text() == "C2"


def test_outputs_adopted_and_missing(spark, tmp_path):
    p, store = chain(tmp_path), ParquetStore(tmp_path / "s")
    run(spark, p, store)
    fresh = ParquetStore(tmp_path / "other")
    p.check_outputs = "fallback"
    assert planned(spark, p, fresh) == {}
    assert report.status(spark, p, fresh)["totals"]["up_to_date"] == 7
    p.check_outputs = "always"
    (tmp_path / "b" / "2002").unlink()
    assert planned(spark, p, store) == {("process", '{"year": 2002}'): ["outputs-missing"], ("combine", "{}"): ["upstream-rerun"]}


def test_lint(spark, tmp_path):
    gen = rule(outputs={"x": "out/gen/{n}.txt"}, matrix={"n": [1, 2]}, name="gen")(lambda outputs, n: None)
    proc = rule(inputs={"x": "out/genn/{n}.txt"}, outputs={"x": "out/proc/{n}.txt"}, matrix={"n": [1, 2]}, depends_on=[gen], name="proc")(lambda inputs, outputs, n: None)
    agg = rule(inputs={"a": "out/proc/1.txt", "b": "elsewhere/raw.csv"}, name="agg")(lambda inputs: None)
    got = [(r.kind, r.rule, r.other_rule, r.n, r.closest) for r in report.lint(spark, Pipeline([gen, proc, agg])).collect()]
    assert got == [("near_miss", "proc", "gen", 2, "out/gen/1.txt"), ("external", "agg", None, 1, None), ("missing_dependency", "agg", "proc", 1, None)]


def test_paths_of_a_grid_are_the_lists(spark):
    grid = {"z": ["it's", None, 1.5], ("b", "a"): [(1, True), (-3, False)]}
    r = Rule(lambda inputs, outputs, z, a, b: None, inputs={"x": "in/{a}/{z}"}, outputs={"y": Output("o/{b}-{a}.{z}"), "k": "const"}, matrix=grid, given_name="r")
    odd = Rule(lambda outputs, n: None, outputs={"y": "o/{n:03d}"}, matrix={"n": [1, 22]}, given_name="odd")
    found, _ = report.files(spark, Pipeline([r, odd]))
    want = [("r", part, str(v)) for k in r.rows() for part, spec in (("in", r.inputs), ("out", r.outputs)) for v in (str(t).format(**k) for t in spec.values())]
    assert sorted(map(tuple, found.collect())) == sorted([*want, ("odd", "out", "o/001"), ("odd", "out", "o/022")])


def test_lookup_and_infos(spark, tmp_path):
    p, store = chain(tmp_path), ParquetStore(tmp_path / "s")
    key = task_key("combine", {})
    assert report.find(spark, p, key[:12]).rule == "combine"
    with pytest.raises(LookupFailed):
        report.find(spark, p, query="rule == 'generate'")
    assert report.task_info(spark, p, store, key)["outputs"]["x"]["complete"] is False
    assert report.rule_dag(p, True) == {"order": ["generate", "process", "combine"], "edges": {"generate": ["process"], "process": ["combine"], "combine": []}, "matrix": {"generate": [3, ["year"]], "process": [3, ["year"]], "combine": [1, []]}}
    assert report.rule_info(p, "process")["needed_by"] == ["combine"]
    assert report.why(spark, p, store, key=key).collect()[0].will_run


def test_results_of_elsewhere(spark, tmp_path):
    p, store = chain(tmp_path), ParquetStore(tmp_path / "s")
    r = p["generate"]
    texts = {"run_hash": r.source, "uses_hash": code.uses_text(r.uses), "io_hash": code.io_text(r.inputs, r.outputs)}
    for y in (2000, 2001):
        write_result(tmp_path / "results", r.key({"year": y}), rule="generate", status=1, exception="", run_seq=1, timestamp="2024-01-01 00:00:00", resources={"wall_s": 1.5, "cpu_s": None, "max_rss_bytes": 10, "rss_method": "x"}, **texts)
    (tmp_path / "results" / "ab").mkdir()
    (tmp_path / "results" / "ab" / "bad.json").write_text("{nonsense")
    assert ingest(spark, tmp_path / "results", store) == 2 and ingest(spark, tmp_path / "results", store) == 0
    assert [f.name for f in (tmp_path / "results").glob("*/*.json")] == ["bad.json"]  # what could not be read stays
    assert {k for k in planned(spark, p, store) if k[0] == "generate"} == {("generate", '{"year": 2002}')}
    write_result(tmp_path / "later", r.key({"year": 2002}), rule="generate", status=1, exception="", run_seq=2, timestamp="2024-01-02 00:00:00", **texts)
    ingest_stream(spark, str(tmp_path / "later"), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert {k[0] for k in planned(spark, p, store)} == {"process", "combine"}
    tasks = report.all_tasks(spark, p)
    write_spec(tmp_path / "specs", 3, "generate", tasks)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_spec(tmp_path / "specs", 3, "generate", tasks)


def test_a_late_result_does_not_replace_a_newer_one(spark, tmp_path):
    p, store = chain(tmp_path), ParquetStore(tmp_path / "s")
    key = p["generate"].key({"year": 2000})
    for number, (seq, status) in enumerate(((9, 1), (2, 2), (None, 2), (9, 2), (10, 1))):
        write_result(tmp_path / "results", key, rule="generate", status=status, run_seq=seq, timestamp="2024-01-01 00:00:00")
        assert ingest(spark, tmp_path / "results", store, p) == 1
        (record,) = store.records(spark).collect()
        assert (record.status, record.run_seq) == ((1, 9) if number < 4 else (1, 10))
    # an older writer's result without hashes gets the present code's ids, so that it causes no rerun
    assert ("generate", '{"year": 2000}') not in planned(spark, p, store)


def test_a_replayed_batch_is_taken_once(spark, tmp_path):
    store = ParquetStore(tmp_path / "s")
    event = spark.createDataFrame([("a", "exec", 1)], "key string, kind string, status int")
    store.take("batch#0", event)
    store.take("batch#0", event)
    assert store.events(spark).count() == 1 and store.taken("batch#0") and not store.taken("batch#1")


def test_outputs_are_found_by_listing(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "_SUCCESS").write_text("")
    (tmp_path / "z").mkdir()
    (tmp_path / "a 1%.txt").write_text("")
    specs = {"x": f"{tmp_path}/a {{n}}%.txt", "t": spark_table(f"{tmp_path}/t"), "own": Output("job {n}", check=lambda name: name.endswith("1"))}
    tasks = task_frame(spark, Rule(lambda outputs, n: None, outputs=specs, matrix={"n": [1, 2]}, given_name="r"), 0)
    for spec, want in ((specs, [(3, True), (3, False)]), ({"z": array_store(f"{tmp_path}/z")}, [(1, False)] * 2), (None, [(0, False)] * 2), (lambda n: {"x": str(tmp_path / "z")}, [(1, True)] * 2)):
        assert [(r.outputs, r.complete) for r in with_completeness(tasks, spec).orderBy("ord").collect()] == want
    with pytest.raises(Exception, match="an output is a path"):
        with_completeness(tasks, lambda n: {"x": 5}).collect()


def test_relation_as_matrix(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    up = Rule(lambda n, s: None, matrix=lambda: frame, given_name="up")
    got = task_frame(spark, up, 0, "n > 1 or s == 'a'").collect()
    assert {(r.kw, r.key) for r in got} == {(json.dumps(k), task_key("up", k)) for k in ({"n": 1, "s": "a"}, {"n": 2, "s": None})}
    assert up.elementwise(Rule(lambda n, s: None, matrix=up.matrix)) and not up.elementwise(Rule(lambda: None))
    with pytest.raises(SignatureError):
        Rule(lambda n: None, matrix=lambda: frame, given_name="odd").grid()


def test_bound_function_sees_declared_names():
    def outer():
        inner, other = 1, 2
        return lambda x=0, *, y=0: (inner, other, x, y)

    fn = outer()
    assert code.Bound(fn, {"inner": 7})(3, y=4) == (7, 2, 3, 4) and fn() == (1, 2, 0, 0)


def test_sampling_interval():
    from freshet.plans import execute

    assert [execute.sampling_interval(x) for x in (0, -1, "junk", None, 1e-9, "0.05", 2, float("nan"), float("inf"))] == [0.05, 0.05, 0.05, 0.05, 0.01, 0.05, 2, 0.05, 0.05]
    sampler = execute.MemorySampler()
    sampler.start()
    held = bytearray(80_000_000)
    peak, method = sampler.finish()
    assert peak > len(held) and method in ("sampled", "process-peak")


def test_state_versions_clash(spark, tmp_path):
    one, two = ParquetStore(tmp_path / "s"), ParquetStore(tmp_path / "s")
    assert one.begin() == 1 and two.begin() == 2
    with pytest.raises(Exception, match="exist"):
        one.manifests.write({}, 1)
    (tmp_path / "s" / "state-000000000009.json").write_text("{cut off")
    assert one.begin() == 3


def test_store_folds(spark, tmp_path):
    store = ParquetStore(tmp_path / "s")
    event = lambda **k: store.append(spark.createDataFrame([k], ", ".join(f"{c} {t}" for c, t in {"key": "string", "kind": "string", "status": "int", "wall_s": "double", "run_seq": "long"}.items() if c in k)))
    event(key="a", kind="exec", status=1, wall_s=2.0, run_seq=1)
    event(key="a", kind="state", status=1, run_seq=2)
    assert [(r.run_seq, r.wall_s) for r in store.records(spark).collect()] == [(2, 2.0)]
    event(key="a", kind="delete")
    assert store.records(spark).count() == 0
    event(key="a", kind="state", status=1, run_seq=3)
    assert [(r.run_seq, r.wall_s) for r in store.records(spark).collect()] == [(3, None)]
    store.compact(spark)
    assert [(r.run_seq, r.wall_s) for r in store.records(spark).collect()] == [(3, None)]
    assert store.intern(["x", "y", "x"]) == [0, 1, 0] and store.text({1, None}) == {1: "y"}


def test_matrix_forms():
    assert rows_of(None) == rows_of({}) == [{}]
    assert rows_of({"a": [1, 2], "b": ["x", "y"]}) == [{"a": a, "b": b} for a in (1, 2) for b in "xy"]
    assert rows_of({("a", "b"): [(1, 2)], "c": [3, 4]}) == [{"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 2, "c": 4}]
    assert rows_of([{"a": 1}, {"a": 1}]) == [{"a": 1}, {"a": 1}]
    for bad in ({("a", "b"): [(1,)]}, {"a": [(1, 2)]}, [{"a": 1}, {"b": 1}], [{"a": {}}]):
        with pytest.raises(SignatureError):
            rows_of(bad)

    def unmarked():
        raise Defer("x")

    with pytest.raises(SignatureError):
        rows_of(unmarked)
    assert len({task_key("r", {"a": v}) for v in (1, 1.0, True)}) == 3 and len({kwargs_id({"a": v}) for v in (1, 1.0, True)}) == 1


def test_contract():
    good = dict(inputs={"x": "a/{n}"}, outputs={"y": Output("b/{n}")}, matrix={"n": [1]})
    assert isinstance(rule(**good)(lambda inputs, outputs, n: None), Rule)
    for fn, spec in ((lambda outputs, inputs, n: None, good), (lambda inputs, outputs: None, good), (lambda inputs, outputs, n, m: None, good), (lambda *a: None, {}), (lambda inputs: None, {}), (lambda inputs: None, {"inputs": {}}), (lambda inputs, n: None, {"inputs": {"x": "{m}"}, "matrix": {"n": [1]}}), (lambda inputs, n: None, {"inputs": lambda m: {}, "matrix": {"n": [1]}})):
        with pytest.raises(SignatureError):
            rule(**spec)(fn)


def test_code_tracking():
    assert code.same_code("def f():\n  return 1", "def f():\n    # why\n    return 1") and not code.same_code("x = 1", "x = 2")
    assert not code.same_code("x = (", "x = [") and not code.same_code("x\0", "y\0")
    uses = {"a": 1, "f": rows_of}
    assert code.parsed_version(code.uses_text(uses)) == {"a": "1", "f": code.version(rows_of)}
    assert "a: 1 -> 2" in code.uses_change(code.uses_text({"a": 1}), {"a": 2}) and "(added)" in code.uses_change("", {"a": 2})
    assert "(added)" in code.uses_change("a=1", {"a": 2}) and "inputs and outputs" in code.io_change("inputs=", code.io_text({"x": "a"}, {"y": "b"}))
    assert code.undeclared(chain, {}) and "json" not in code.undeclared(test_deferred_matrix, {})


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "p.py").write_text(
        "from freshet import Pipeline, rule\n"
        f"@rule(outputs={{'x': {str(tmp_path)!r} + '/o/{{n}}'}}, matrix={{'n': [1, 2]}})\n"
        "def gen(outputs, n):\n    if n == 2:\n        raise KeyError(n)\n    print('task', n)\n    open(outputs['x'], 'w').write('')\n"
        "pipeline = Pipeline([gen])\n"
    )
    p = str(tmp_path / "p.py")
    assert main([], spark) == 1 and main(["version"], spark) == 0
    assert main(["run", p], spark) == 1
    capsys.readouterr()
    assert main(["info", p, "--json", "--failures"], spark) == 0
    info = json.loads(capsys.readouterr().out)
    assert info["totals"]["failed"] == 1 and info["failures"][0]["type"] == "KeyError"
    assert main(["task-log", p, "-Q", "n == 1"], spark) == 0 and capsys.readouterr().out == "task 1\n"
    events = {r.event: r for r in files.log_events(spark, tmp_path / ".freshet" / "logs").collect()}
    assert events["rule"].n == 2 and events["plan"].seconds > 0
    for args in (["why", p, "--json"], ["ls-tasks", p, "-Q", "n == 1"], ["lint", p], ["rule-dag", p, "--matrix"], ["rule-info", p, "gen"], ["task-info", p, "-Q", "n == 1"], ["set-state", p, "-Q", "n == 2", "--success"]):
        assert main(args, spark) == 0
    assert main(["run", p], spark) == 0 and main(["run", str(tmp_path / "none.py")], spark) == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# made by hand\n# twice\ntime,value\n1,2.5\n2,x\n")
    assert files.read_lines(spark, str(tmp_path / "a.csv")).count() == 3
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "a.csv"), "time int, value double").collect()] == [(1, 2.5), (2, None)]
    (tmp_path / "j.json").write_text('{"id": "e1", "strength": 0.5}\nnonsense\n')
    assert files.fan_in(spark, [str(tmp_path / "j.json")], "id string, strength double").where("id is not null").count() == 1
    table = str(tmp_path / "region")
    for region, values in ((0, [1, 2]), (1, [3]), (0, [9])):
        files.write_region(spark.createDataFrame([(region, v) for v in values], "region int, v int"), table, ["region"])
    assert sorted(map(tuple, spark.read.parquet(table).select("region", "v").collect())) == [(0, 9), (1, 3)]
    assert [r.value for r in files.as_json(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b")).collect()] == ['{"a":1}']
