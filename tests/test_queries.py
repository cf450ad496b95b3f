"""The query language compiled to columns against the plain evaluator and Python's own; the catalogue against its SQL."""

import collections
import os
import random

import duckdb
import pytest

from freshet.functions.errors import QueryError
from freshet.functions.predicate import compile_query, evaluate
from freshet.operators import store
from freshet.operators.reports import failure_groups, failure_members, near_misses
from freshet.plans import catalogue
from freshet.plans.model import Rule, task_frame, kwargs_id, task_key

SF = "/root/testdata/sf0.001"


def expression(rng, depth=3):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["a == 1", "b > 2", "a < b", "s == 'x'", "missing > 1", "rule == 'r'", "a in [1, 2]", "s in ['x', 'yy']", "0 < a <= 2", "a != b", "s.startswith('y')", "a + b > 3", "rule in ['q', 'r']", "s not in ['x']", "a % 2 == 1", "-a < 0"])
    left, right = expression(rng, depth - 1), expression(rng, depth - 1)
    return rng.choice([f"({left} and {right})", f"({left} or {right})", f"(not {left})"])


def by_python(text, kwargs):
    try:
        return bool(eval(text, {"__builtins__": {}}, kwargs | {"rule": "r"}))
    except NameError:
        return False


def test_compiled_queries_agree_with_python(spark):
    rng = random.Random(11)
    rows = [(i, a, b, s) for i, (a, b, s) in enumerate((a, b, s) for a in range(4) for b in (1, 3) for s in ("x", "yy", ""))]
    frame = spark.createDataFrame(rows, "id long, a long, b long, s string").cache()
    texts = [expression(rng) for _ in range(60)]
    got = frame.select("id", *[compile_query(t, {"a", "b", "s"}, "r").alias(f"q{i}") for i, t in enumerate(texts)]).collect()
    for r in got:
        kwargs = dict(zip(("a", "b", "s"), rows[r.id][1:]))
        for i, t in enumerate(texts):
            assert r[f"q{i}"] == by_python(t, kwargs) == evaluate(t, kwargs, "r"), (t, kwargs)


def test_query_edges(spark):
    one = spark.createDataFrame([(None, "r", 0)], "n string, rule string, z long")
    for text, want in (("n == None", True), ("n is not None", False), ("not foo", False), ("foo or True", False), ("True or foo", True), ("rule == 'own'", True), ("z", False), ("not z", True), ("len(rule) > 1", False), ("'ow' in rule", True)):
        assert one.where(compile_query(text, {"n", "rule", "z"}, "own")).count() == int(want), text
        assert evaluate(text, {"n": None, "rule": "r", "z": 0}, "own") == want, text
    for text in ("a ===", "[x for x in y]", "a.b.c", "lambda: 1", "__import__('os').system('x')"):
        with pytest.raises(QueryError):
            compile_query(text, {"a"}, "r")
    with pytest.raises(TypeError):
        evaluate("'2000' > 1985", {}, "r")


def test_product_frame_is_the_list(spark):
    matrix = {"z": ["it's", 'a"b', None, "é"], ("b", "a"): [(1, 2.5), (True, 1e16), (-3, 0.1)], "c": [1, 1.0, False]}
    rule = Rule(lambda z, a, b, c: None, matrix=matrix, given_name="r")
    got = task_frame(spark, rule, 0).orderBy("ord").collect()
    rows = rule.rows()
    assert [(r.ord, r.key, r.kw_id) for r in got] == [(i, task_key("r", k), kwargs_id(k)) for i, k in enumerate(rows)]
    simple = Rule(lambda n, s: None, matrix={"n": [1, 2, 3], "s": ["x", "y"]}, given_name="r")
    assert [r.ord for r in task_frame(spark, simple, 0, query="n > 1 and s == 'y' or nothing").orderBy("ord").collect()] == [3, 5]


def test_near_misses_are_difflibs(spark):
    import difflib

    rng = random.Random(3)
    names = sorted({"out/" + "".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))) + f"/{i % 7}.txt" for i in range(60)})
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: r.suggestion for r in near_misses(frame, frame).collect()}
    want = {n: c[0] for n in names if (c := difflib.get_close_matches(n, [x for x in names if x != n], n=1, cutoff=0.9))}
    assert got == want and got


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_catalogue(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    sql = duck.sql(catalogue.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(sql.columns)
    order = [sql.columns.index(n) for n in names]
    plain = lambda v: str(v)[:10] if hasattr(v, "year") else repr(v)
    assert sorted(tuple(map(plain, r)) for r in got.select(*names).collect()) == sorted(tuple(plain(r[i]) for i in order) for r in sql.fetchall())


def test_every_runnable_task_has_a_place(spark):
    got = catalogue.queries()["runnable_order"](spark, SF).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(got) + 1)) and len(got) > 50
    rows = spark.createDataFrame([("b", 2), (None, 7), ("b", 1), ("a", 9)], "rule string, id long")
    assert sorted(tuple(r) for r in store.places(rows, "rule", ["id"]).collect()) == [(1, None, 7), (2, "a", 9), (3, "b", 1), (4, "b", 2)]


def test_places_in_large_groups(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'hot' END AS g", "(id * 7919) % 500 AS v")
    got = {r.id: r["at"] for r in store.numbered(rows, "g", ["v", "id"], "at").collect()}
    for members in ([i for i in range(3000) if i % 3 == 0], [i for i in range(3000) if i % 3]):
        assert [got[i] for i in sorted(members, key=lambda i: ((i * 7919) % 500, i))] == list(range(len(members)))


def test_failure_members_are_all_listed(spark):
    trace = 'Traceback (most recent call last):\n  File "run.py", line {}, in step\n{}: x'
    rows = [(i, f"k{i}", trace.format(i % 2, "KeyError" if i % 3 else "ValueError")) for i in range(12)] + [(12, "k12", None), (13, "k13", None)]
    failed = spark.createDataFrame(rows, "at long, key string, exception string")
    got = failure_members(failed, "at", "exception", "key").collect()
    assert sorted(r.key for r in got) == sorted(k for _, k, _ in rows)
    sizes = collections.Counter((r.type, r.first_seen) for r in got)
    assert sizes == {(g.type, g.first_seen): g.n for g in failure_groups(failed, "at", "exception", "key").collect()} and max(sizes.values()) == 4


def test_discovered_shares_on_odd_events(spark, tmp_path):
    """Equal strengths, null ids and strengths, groups whose strengths sum to nothing, shares just below a half."""
    rows = [(3, 5.0, 1), (7, 5.0, 1), (8, 1.0, 1), (None, 9.0, 1), (9, None, 1), (10, 0.0, 2), (11, 0.0, 2), (12, -3.0, 3), (13, 3.0, 3), (14, None, 4), (15, 1.0, None), (16, 1e308, 5), (17, 1e308, 5)]
    rows += [(18 + 2 * i + j, v, 6 + i) for i, x in enumerate((0.44999999999999996, 1.8499999999999999, 3.3499999999999996, 2.25)) for j, v in enumerate((x, 100 - x))]
    spark.createDataFrame(rows, "event_id long, value double, user_id long").coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = catalogue.queries()["discovered_shares"](spark, str(tmp_path)).select("id", "share", "is_strongest")
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, con.sql(catalogue.oracle_sql()["discovered_shares"]).fetchall()))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
