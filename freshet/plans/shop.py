"""Pipelines over the driver's tables, so that the registered queries run the planner, the cascade, lint and reports themselves.

``shop``: ``order`` for each order, ``ship`` with the same matrix downstream of it, ``stamp`` for each region and ``total``
downstream of these; its records are made from the orders. ``calm``: nothing reruns, but ``late`` ran before ``order``.
``grid``: ``load`` for nation x year and ``merge`` for each nation, partly recorded. ``miswired``: one finding of each kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.plans.model import Pipeline, Rule, kwargs_id, task_key
from freshet.sources.state import EVENTS, FAILED, SUCCESS, StateStore, track

OLD = "def fn(): raise SystemExit"
#: Run clocks of the shop's orders, in months.
CLOCK = "(year(o_orderdate) - 1990) * 12 + month(o_orderdate)"


class TableStore(StateStore):
    """Records that are made from relations; texts are held in memory. Nothing is written."""

    def __init__(self):
        self.frames: dict[str, DataFrame] = {}
        self.texts: list[str] = []

    def records(self, spark: SparkSession, rule: str | None = None) -> DataFrame:
        out = spark.createDataFrame([], EVENTS)
        for name, frame in self.frames.items():
            if rule in (None, name):
                out = out.unionByName(frame.withColumn("rule", F.lit(name)), allowMissingColumns=True)
        return out.drop("kind", "event_seq")

    def append(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError("records are made from tables")

    def intern(self, texts: list[str]) -> list[int]:
        self.texts += [t for t in texts if t not in self.texts]
        return [self.texts.index(t) for t in texts]

    def text(self, ids) -> dict[int, str]:
        return {i: self.texts[i] for i in ids if i is not None}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def key_column(rule: str, **kwargs: str) -> Column:
    """The key of tasks whose kwargs are whole numbers in columns."""
    parts = [F.lit(f"{rule}:{{")]
    for k, (name, column) in enumerate(sorted(kwargs.items())):
        parts += [F.lit(f"{', ' if k else ''}{name!r}: "), F.col(column).cast("string")]
    return F.sha1(F.concat(*parts, F.lit("}")).cast("binary"))


def _rule(fn, name: str, **more) -> Rule:
    return Rule(fn, given_name=name, **more)


def shop(spark: SparkSession, d: str) -> tuple[Pipeline, TableStore]:
    orders = table(spark, d, "orders").withColumn("clock", F.expr(CLOCK).cast("long"))

    def all_orders() -> DataFrame:
        return orders.select(F.col("o_orderkey").alias("o"))

    order = _rule(lambda o: None, "order", matrix=all_orders, uses={"rate": 2})
    ship = _rule(lambda o: None, "ship", matrix=all_orders, depends_on=[order])
    regions = sorted(r.r_name for r in table(spark, d, "region").select("r_name").collect())
    stamp = _rule(lambda region: None, "stamp", matrix={"region": regions}, depends_on=[ship])
    total = _rule(lambda: None, "total", depends_on=[stamp])
    store, codes = TableStore(), {}
    (old,) = store.intern([OLD])
    for r in (order, ship, stamp, total):
        codes[r] = [F.lit(i).cast("long") for i in track(store, r)]
    run, uses, io = codes[order]
    was = lambda n, now: F.when(F.col("o_custkey") % n == 0, F.lit(old).cast("long")).otherwise(now)
    store.frames["order"] = orders.where("o_orderkey % 10 <> 0").select(
        key_column("order", o="o_orderkey").alias("key"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 0), FAILED).otherwise(SUCCESS).alias("status"), F.lit("then").alias("ts"),
        was(7, run).alias("run_code_id"), was(11, uses).alias("uses_code_id"), F.when(F.col("o_custkey") % 5 != 0, was(13, io)).alias("io_code_id"), F.col("clock").alias("run_seq"))
    run, uses, io = codes[ship]
    store.frames["ship"] = orders.where("o_orderkey % 15 <> 0").select(
        key_column("ship", o="o_orderkey").alias("key"), F.lit(SUCCESS).alias("status"), F.lit("then").alias("ts"), run.alias("run_code_id"), uses.alias("uses_code_id"), io.alias("io_code_id"),
        F.when(F.col("o_custkey") % 17 != 0, F.col("clock") + F.col("o_custkey") % 4 - 1).alias("run_seq"))
    for r, rows in ((stamp, [({"region": x}, 50 if i < 2 else 1000) for i, x in enumerate(regions)]), (total, [({}, 1)])):
        made = spark.createDataFrame([(task_key(r.name, kw), SUCCESS, "then", seq) for kw, seq in rows], "key string, status int, ts string, run_seq long")
        store.frames[r.name] = made.withColumns(dict(zip(("run_code_id", "uses_code_id", "io_code_id"), codes[r])))
    return Pipeline([order, ship, stamp, total], store=store), store


def calm(spark: SparkSession, d: str) -> tuple[Pipeline, TableStore]:
    orders = table(spark, d, "orders")
    order = _rule(lambda o: None, "order", matrix=lambda: orders.select(F.col("o_orderkey").alias("o")))
    late = _rule(lambda o: None, "late", matrix=lambda: table(spark, d, "customer").select(F.col("c_custkey").alias("o")), depends_on=[order])
    store = TableStore()
    for r, name, clock, keys in ((order, "o_orderkey", F.expr(CLOCK), orders), (late, "c_custkey", F.col("c_custkey") % 200, table(spark, d, "customer"))):
        ids = [F.lit(i).cast("long") for i in track(store, r)]
        store.frames[r.name] = keys.select(key_column(r.name, o=name).alias("key"), F.lit(SUCCESS).alias("status"), F.lit("then").alias("ts"), *[i.alias(c) for i, c in zip(ids, ("run_code_id", "uses_code_id", "io_code_id"))], clock.cast("long").alias("run_seq"))
    return Pipeline([order, late], store=store), store


def grid_rules(spark: SparkSession, d: str) -> list[Rule]:
    nations = [r.n_name for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    years = sorted(r.y for r in table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().collect())
    specs = {"outputs": {"x": "out/{nation}/{year}.nc"}, "inputs": {"raw": "in/{year}/{nation}.csv"}}
    load = _rule(lambda inputs, outputs, nation, year: None, "load", matrix={"nation": nations, "year": years}, **specs)
    merge = _rule(lambda nation: None, "merge", matrix={"nation": nations}, depends_on=[load])
    return [load, merge]


def grid(spark: SparkSession, d: str) -> tuple[Pipeline, TableStore]:
    load, merge = grid_rules(spark, d)
    store = TableStore()
    for r, kept in ((load, lambda i, kw: (i + kw["year"]) % 3), (merge, lambda i, kw: i % 4)):
        ids = track(store, r)
        rows = [(task_key(r.name, kw), SUCCESS, "then", *ids, 5) for i, kw in enumerate(r.rows()) if kept(i, kw)]
        store.frames[r.name] = spark.createDataFrame(rows, "key string, status int, ts string, run_code_id long, uses_code_id long, io_code_id long, run_seq long")
    return Pipeline([load, merge], store=store), store


def miswired(spark: SparkSession, d: str) -> Pipeline:
    nations = [r.n_name for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    gen = _rule(lambda outputs, n: None, "gen", outputs={"x": "out/gen/{n}.txt"}, matrix={"n": nations})
    proc = _rule(lambda inputs, outputs, n: None, "proc", inputs={"x": "out/genn/{n}.txt"}, outputs={"x": "out/proc/{n}.txt"}, matrix={"n": nations}, depends_on=[gen])
    agg = _rule(lambda inputs, n: None, "agg", inputs={"a": "out/proc/{n}.txt", "b": "elsewhere/{n}.csv"}, matrix={"n": nations})
    return Pipeline([gen, proc, agg])


def family(spark: SparkSession, d: str) -> Pipeline:
    """A rule for each nation, downstream of the one with half its number."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()
    rules: dict[int, Rule] = {}
    for r in rows:
        above = [rules[r.n_nationkey // 2]] if r.n_nationkey // 2 in rules else []
        rules[r.n_nationkey] = _rule(lambda: None, r.n_name, depends_on=above)
    return Pipeline(list(rules.values())[::-1])


def selected(spark: SparkSession, rule: str, kwargs: list[dict]) -> DataFrame:
    return spark.createDataFrame([(rule, kwargs_id(kw)) for kw in kwargs], "rule string, kw_id string")
