"""Plans and cascades of random pipelines against a plain model of the rules."""

import json
import random

import pytest

from freshet import ParquetStore, Pipeline, Rule, plan
from freshet.plans.model import kwargs_id, task_key
from freshet.plans.planner import cascade
from freshet.sources.state import track


def pipeline(rng):
    grids = [None, {"n": [1, 2, 3]}, {"n": [1, 2, 3], "s": ["x", "y"]}, [{"n": 2}, {"n": 5}]]
    rules = []
    for i in range(5):
        matrix = rng.choice(grids)
        names = [] if matrix is None else sorted(matrix if isinstance(matrix, dict) else matrix[0])
        fn = {(): lambda: None, ("n",): lambda n: None, ("n", "s"): lambda n, s: None}[tuple(names)]
        rules.append(Rule(fn, matrix=matrix, depends_on=rng.sample(rules, rng.randrange(min(3, len(rules)) + 1)), given_name=f"r{i}"))
    return Pipeline(rules)


def state(rng, spark, p, store):
    """Random records: missing, failed, of other code, with or without a clock."""
    rows = []
    for r in p.rules:
        run, uses, io = track(store, r)
        (other,) = store.intern(["def other(): pass"])
        for k in r.rows():
            if rng.random() < 0.8:
                rows.append((task_key(r.name, k), r.name, "exec", 2 if rng.random() < 0.1 else 1, run if rng.random() < 0.9 else other, uses, io if rng.random() < 0.7 else None, rng.choice([None, 3, 3, 3, 4])))
    store.append(spark.createDataFrame(rows, "key string, rule string, kind string, status int, run_code_id long, uses_code_id long, io_code_id long, run_seq long"))
    return {r[0]: dict(status=r[3], same=r[4] != other, seq=r[7]) for r in rows}


def upstream(p, r, kid, values):
    for d in r.depends_on:
        yield from ([values[d][kid]] if r.elementwise(d) and kid in values[d] else [] if r.elementwise(d) else values[d].values())


def model(p, records):
    will, seqs = {}, {}
    for r in p.order:
        will[r], seqs[r] = {}, {}
        for k in r.rows():
            rec, kid = records.get(task_key(r.name, k)), kwargs_id(k)
            own = rec is None or rec["status"] != 1 or not rec["same"]
            clocks = [s for s in upstream(p, r, kid, seqs) if s is not None]
            newer = rec is not None and rec["seq"] is not None and bool(clocks) and max(clocks) > rec["seq"]
            will[r][kid], seqs[r][kid] = own or any(upstream(p, r, kid, will)) or newer, rec["seq"] if rec else None
    return will, seqs


@pytest.mark.parametrize("seed", range(4))
def test_random_pipelines(spark, tmp_path, seed):
    rng = random.Random(seed)
    p, store = pipeline(rng), ParquetStore(tmp_path / "s")
    records = state(rng, spark, p, store)
    made = plan(spark, p, store)
    will, seqs = model(p, records)
    assert {(r.rule, r.kw_id) for r in made.tasks.where("will_run").collect()} == {(r.name, kid) for r in p.rules for kid, w in will[r].items() if w}
    for r in made.tasks.collect():
        assert r.will_run == bool([x for x in r.reasons if x.category != "adopted-outputs"])
    # the cascade from one rule's tasks
    seed_rule = p.order[0]
    chosen = {(seed_rule.name, kid) for kid in will[seed_rule]}
    settled = set(chosen)
    for r in p.order:
        for k in r.rows() if r.depends_on else ():
            kid, rec = kwargs_id(k), records.get(task_key(r.name, k))
            if rec is None or rec["status"] != 1 or (r.name, kid) in settled:
                continue
            ups = [(d, u) for d in r.depends_on for u in ([kid] if r.elementwise(d) else seqs[d]) if u in seqs[d]]
            good = any((d.name, u) in settled for d, u in ups)
            bad = any((d.name, u) not in settled and seqs[d][u] is not None and (rec["seq"] is None or seqs[d][u] > rec["seq"]) for d, u in ups)
            if good and not bad:
                settled.add((r.name, kid))
    got = cascade(spark, p, made.by_rule, spark.createDataFrame(sorted(chosen), "rule string, kw_id string"))
    assert {tuple(r) for r in got.select("rule", "kw_id").collect()} == settled
    assert json.loads(made.tasks.first().kw) is not None
