"""The registered queries of the task plane and the data plane, with their SQL.

Planning, cascades, lint and reports run over the pipelines of ``shop.py``, whose tasks and records are made from the driver's
tables, through the functions that the commands use. Elsewhere ``events`` is an execution log (user = key, event = sequence;
signup deletes, error fails), and ``documents.text`` a code store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.functions import columns as C
from freshet.operators import reports, store, workloads
from freshet.operators.propagation import not_tainted
from freshet.plans import report, shop
from freshet.plans.model import Pipeline, Rule, path_frame, task_frame
from freshet.plans.planner import Plan, cascade, plan, versions
from freshet.sources import outputs
from freshet.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- expansion and selection ---

YEARS = "(SELECT DISTINCT year(o_orderdate)::BIGINT AS year FROM orders)"
GRID = f"""SELECT 'load' AS rule, (n_nationkey * (SELECT count(*) FROM {YEARS}) + row_number() OVER (PARTITION BY n_nationkey ORDER BY year) - 1)::BIGINT AS ord, n_name AS nation, year,
 '{{"nation": "' || n_name || '", "year": ' || year || '}}' AS kw, sha1('load:{{''nation'': ''' || n_name || ''', ''year'': ' || year || '}}') AS key FROM nation CROSS JOIN {YEARS}"""
TASK = ["rule", "ord", "kw", "key"]


@query(f"SELECT rule, ord, kw, key FROM ({GRID})")
def matrix_cartesian(spark: SparkSession, d: str) -> DataFrame:
    return task_frame(spark, shop.grid_rules(spark, d)[0], 0).select(*TASK)


@query("""SELECT 'pick' AS rule, sha1('pick:{''brand'': ''' || p_brand || ''', ''region'': ''' || r_name || ''', ''size'': ' || p_size || '}') AS key
 FROM region CROSS JOIN (SELECT DISTINCT p_brand, p_size FROM part)""")
def matrix_grouped_axis(spark: SparkSession, d: str) -> DataFrame:
    """Brand and size are bound together; every pair goes with every region."""
    pairs = [tuple(r) for r in _table(spark, d, "part").select("p_brand", "p_size").distinct().collect()]
    regions = [r.r_name for r in _table(spark, d, "region").select("r_name").collect()]
    pick = Rule(lambda region, brand, size: None, matrix={"region": regions, ("brand", "size"): pairs}, given_name="pick")
    return task_frame(spark, pick, 0).select("rule", "key")


@query("""SELECT 'run' AS rule, i::BIGINT AS ord, '{"level": ' || level || ', "model": "' || model || '"}' AS kw, sha1('run:{''level'': ' || level || ', ''model'': ''' || model || '''}') AS key
 FROM (VALUES (0, 'era5', 1), (1, 'era5', 1), (2, 'cmip', 2), (3, 'cmip', 0)) v(i, model, level)""")
def matrix_explicit(spark: SparkSession, d: str) -> DataFrame:
    rows = [{"model": m, "level": n} for m, n in (("era5", 1), ("era5", 1), ("cmip", 2), ("cmip", 0))]
    return task_frame(spark, Rule(lambda model, level: None, matrix=rows, given_name="run"), 0).select(*TASK)


@query("SELECT 'collect' AS rule, 0::BIGINT AS ord, '{}' AS kw, sha1('collect:{}') AS key")
def matrix_none(spark: SparkSession, d: str) -> DataFrame:
    return task_frame(spark, Rule(lambda: None, given_name="collect"), 0).select(*TASK)


@query("SELECT 'process' AS rule, '{\"k\": ' || k || '}' AS kw, sha1('process:{''k'': ' || k || '}') AS key FROM (SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")
def matrix_dynamic_json(spark: SparkSession, d: str) -> DataFrame:
    """A matrix that a function reads from an upstream's JSON; the tasks are named where the relation lies."""

    def found() -> DataFrame:
        return _table(spark, d, "events").select(F.from_json("props", "k long").alias("kw")).select("kw.*").dropna("all").distinct()

    return task_frame(spark, Rule(lambda k: None, matrix=found, given_name="process"), 0).select("rule", "kw", "key")


SELECT = "year > 1996 and nation in ['NATION_1', 'NATION_7', 'NATION_20'] or year == 1995 and nation < 'NATION_13'"


@query(f"SELECT rule, ord, kw, key FROM ({GRID}) WHERE year > 1996 AND nation IN ('NATION_1', 'NATION_7', 'NATION_20') OR year = 1995 AND nation < 'NATION_13'")
def task_query_filter(spark: SparkSession, d: str) -> DataFrame:
    return task_frame(spark, shop.grid_rules(spark, d)[0], 0, SELECT).select(*TASK)


@query(f"""SELECT rule, kw FROM ({GRID}) WHERE year > 1996
 UNION ALL SELECT 'merge' AS rule, '{{"nation": "' || n_name || '"}}' AS kw FROM nation WHERE n_name >= 'NATION_2'""")
def task_query_missing_name(spark: SparkSession, d: str) -> DataFrame:
    """``merge`` has no ``year``: where it is evaluated the query is false, where ``or`` stops first it is not."""
    load, merge = shop.grid_rules(spark, d)
    text = "rule == 'merge' and nation >= 'NATION_2' or year > 1996"
    found = task_frame(spark, load, 0, text).unionByName(task_frame(spark, merge, 1, text))
    return found.unionByName(task_frame(spark, merge, 1, "year > 1996 or rule == 'merge'")).select("rule", "kw")


@query(f"SELECT 'out' AS part, 'out/' || nation || '/' || year || '.nc' AS path FROM ({GRID}) UNION ALL SELECT 'in', 'in/' || year || '/' || nation || '.csv' FROM ({GRID})")
def path_template(spark: SparkSession, d: str) -> DataFrame:
    return path_frame(spark, shop.grid_rules(spark, d)[0]).select("part", "path")


@query(f"""SELECT rule, kw, key FROM (SELECT rule, kw, key FROM ({GRID}) UNION ALL SELECT 'merge', '{{"nation": "' || n_name || '"}}', sha1('merge:{{''nation'': ''' || n_name || '''}}') FROM nation) WHERE key LIKE 'a%'""")
def key_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    return report.with_prefix(report.all_tasks(spark, Pipeline(shop.grid_rules(spark, d))), "a").select("rule", "kw", "key")


# --- the state store ---

LOG = """SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'delete' WHEN 'view' THEN 'state' ELSE 'exec' END AS kind,
 CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status, value AS wall_s, CASE WHEN value > 50 THEN value END AS cpu_s FROM events"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "delete").when(F.col("event_type") == "view", "state").otherwise("exec")
    return _table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"), F.col("value").alias("wall_s"), F.when(F.col("value") > 50, F.col("value")).alias("cpu_s"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return store.fold(_log(spark, d), "key", "seq", "kind", ["status"], ["wall_s", "cpu_s"])


RECORDS = f"""SELECT a.key, arg_max(a.seq, a.seq) AS seq, arg_max(a.status, a.seq) AS status FROM ({LOG}) a
 LEFT JOIN (SELECT key, max(seq) AS gone FROM ({LOG}) WHERE kind = 'delete' GROUP BY key) g ON a.key = g.key
 WHERE g.gone IS NULL OR a.seq > g.gone GROUP BY a.key"""


@query(f"SELECT key, arg_max(seq, seq) AS seq, arg_max(status, seq) AS status, arg_max(wall_s, seq) AS wall_s FROM ({LOG}) GROUP BY key")
def record_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(_log(spark, d), "key", "seq", ["status", "wall_s"])


@query(RECORDS)
def record_with_tombstone(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("key", "seq", "status")


@query(f"""WITH log AS ({LOG}), gone AS (SELECT key, max(seq) AS gone FROM log WHERE kind = 'delete' GROUP BY key),
 alive AS (SELECT l.* FROM log l LEFT JOIN gone g ON l.key = g.key WHERE g.gone IS NULL OR l.seq > g.gone),
 ran AS (SELECT key, max(seq) AS seq FROM alive WHERE kind = 'exec' GROUP BY key)
 SELECT r.key, r.status, a.wall_s, a.cpu_s FROM (SELECT key, arg_max(status, seq) AS status FROM alive GROUP BY key) r
 LEFT JOIN ran ON r.key = ran.key LEFT JOIN alive a ON a.key = ran.key AND a.seq = ran.seq""")
def resources_last_exec(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("key", "status", "wall_s", "cpu_s")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS code_id FROM documents")
def code_intern(spark: SparkSession, d: str) -> DataFrame:
    return store.interned(_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE source = 'src1')")
def code_unchanged_membership(spark: SparkSession, d: str) -> DataFrame:
    codes = _table(spark, d, "documents")
    return store.unchanged_ids(codes.select("doc_id", "text"), "doc_id", "text", codes.where("source = 'src1'").select("text"))


@query("SELECT l.doc_id, l.quality, l.toxic, d.lang, sha1(d.text) AS code FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def uses_manifest_join(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "lang", F.sha1(F.col("text").cast("binary")).alias("code")), "doc_id").select("doc_id", "quality", "toxic", "lang", "code")


@query("""SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS before, b.v AS after
 FROM (SELECT p_type || '/' || p_brand AS k, count(*) AS v FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1) a
 FULL JOIN (SELECT p_type || '/' || p_brand AS k, count(*) AS v FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def spec_diff_keys(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a spec as name -> value: what was added, removed or changed."""
    part = _table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("name"), "p_partkey")
    old = part.where("p_partkey % 3 <> 0").groupBy("name").agg(F.count("*").alias("before"))
    new = part.where("p_partkey % 3 <> 1").groupBy("name").agg(F.count("*").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return old.join(new, "name", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("name", change.alias("change"), "before", "after")


RESULTS = """SELECT user_id::VARCHAR AS key, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status, event_id % 7 AS run_seq, lpad(event_id::VARCHAR, 9, '0') AS timestamp FROM events"""


@query(f"""SELECT r.key, r.status, r.run_seq, r.timestamp FROM (SELECT key, arg_max(status, run_seq * 1000000000 + timestamp::BIGINT) AS status, max(run_seq) AS run_seq, arg_max(timestamp, run_seq * 1000000000 + timestamp::BIGINT) AS timestamp FROM ({RESULTS}) GROUP BY key) r
 LEFT JOIN (SELECT c_custkey::VARCHAR AS key, c_custkey % 9 AS had, CASE WHEN c_custkey % 2 = 0 THEN '000000100' ELSE '999999999' END AS ts FROM customer WHERE c_custkey % 4 <> 0) k ON k.key = r.key
 WHERE k.key IS NULL OR r.run_seq > k.had OR r.run_seq = k.had AND r.timestamp > k.ts""")
def ingest_late_results(spark: SparkSession, d: str) -> DataFrame:
    """The newest result of each task by its run clock, but where the record ran later."""
    results = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status"), (F.col("event_id") % 7).alias("run_seq"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("timestamp"))
    records = _table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("key"), (F.col("c_custkey") % 9).alias("run_seq"), F.when(F.col("c_custkey") % 2 == 0, "000000100").otherwise("999999999").alias("ts"))
    return ingest.unsurpassed(ingest.newest(results), records).select("key", "status", "run_seq", "timestamp")


@query("SELECT DISTINCT run_seq, run_seq = max(run_seq) OVER () AS is_latest FROM (SELECT (event_id // 500)::BIGINT AS run_seq FROM events)")
def latest_spec(spark: SparkSession, d: str) -> DataFrame:
    runs = _table(spark, d, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("run_seq")).distinct()
    return store.marked_latest(runs, "run_seq").select("run_seq", "is_latest")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY
 AND o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders)""")
def spec_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Specs of more than seven days go, but for the one submitted last."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    now = orders.agg(F.max("o_orderdate").alias("now")).first().now
    return store.outdated(store.marked_latest(orders, "o_orderkey"), "o_orderdate", F.lit(now), 7).select("o_orderkey")


# --- planning: own reasons and propagation ---

CLOCK = "(year(o_orderdate) - 1990) * 12 + month(o_orderdate)"
ORDERS = f"""SELECT o_orderkey AS o, {CLOCK} AS clock, CASE WHEN o_orderkey % 10 <> 0 THEN CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 2 ELSE 1 END END AS status,
 o_custkey % 7 = 0 AS code, o_custkey % 11 = 0 AS uses, o_custkey % 5 <> 0 AND o_custkey % 13 = 0 AS io FROM orders"""
ORDER = f"""SELECT o, clock, status, CASE WHEN status IS NULL THEN 'never-run' ELSE concat_ws('+', CASE WHEN status = 2 THEN 'last-run-failed' END, CASE WHEN code THEN 'code-changed' END,
 CASE WHEN uses THEN 'uses-changed' END, CASE WHEN io THEN 'io-changed' END) END AS reasons FROM ({ORDERS})"""
SHIP = f"""SELECT o, own, recorded, concat_ws('+', CASE WHEN NOT recorded THEN 'never-run' END, CASE WHEN up THEN 'upstream-rerun' END,
 CASE WHEN recorded AND NOT up AND clock > own THEN 'upstream-newer' END) AS reasons FROM (
 SELECT o_orderkey AS o, o_orderkey % 15 <> 0 AS recorded, CASE WHEN o_custkey % 17 <> 0 THEN {CLOCK} + o_custkey % 4 - 1 END AS own, CASE WHEN s.status IS NOT NULL THEN s.clock END AS clock, s.reasons <> '' AS up
 FROM orders JOIN ({ORDER}) s ON s.o = o_orderkey)"""
SHOP = f"""SELECT 'order' AS rule, '{{"o": ' || o || '}}' AS kw, status, reasons FROM ({ORDER}) UNION ALL SELECT 'ship', '{{"o": ' || o || '}}', CASE WHEN recorded THEN 1 END, reasons FROM ({SHIP})
 UNION ALL SELECT 'stamp', '{{"region": "' || r_name || '"}}', 1, 'upstream-rerun' FROM region UNION ALL SELECT 'total', '{{}}', 1, 'upstream-rerun'"""


def _planned(spark: SparkSession, d: str) -> Plan:
    pipeline, records = shop.shop(spark, d)
    return plan(spark, pipeline, records)


def _told(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("reasons", F.array_join(F.col("reasons.category"), "+"))


def _of(found: Plan, rule: str) -> DataFrame:
    return _told(next(f for r, f in found.by_rule.items() if r.name == rule)).withColumn("o", F.get_json_object("kw", "$.o").cast("long"))


@query(f"SELECT o, coalesce(status, 0)::BIGINT AS status, reasons <> '' AS will_run, reasons FROM ({ORDER})")
def own_rerun_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _of(_planned(spark, d), "order").select("o", F.coalesce("status", F.lit(0)).cast("long").alias("status"), "will_run", "reasons")


@query(f"SELECT rule, kw, reasons FROM ({SHOP}) WHERE reasons <> ''")
def rerun_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that reruns, over element-wise and conservative edges, and why."""
    return _told(_planned(spark, d).tasks.where("will_run")).select("rule", "kw", "reasons")


@query(f"SELECT o FROM ({SHIP}) WHERE reasons LIKE '%upstream-rerun%'")
def rerun_elementwise(spark: SparkSession, d: str) -> DataFrame:
    return _of(_planned(spark, d), "ship").where("contains(reasons, 'upstream-rerun')").select("o")


@query(f"SELECT kw, reasons FROM ({SHOP}) WHERE rule = 'stamp' OR rule = 'total'")
def rerun_conservative(spark: SparkSession, d: str) -> DataFrame:
    found = _planned(spark, d)
    return _of(found, "stamp").unionByName(_of(found, "total")).select("kw", "reasons")


@query(f"SELECT o FROM ({SHIP}) WHERE reasons = 'upstream-newer'")
def durable_newer(spark: SparkSession, d: str) -> DataFrame:
    return _of(_planned(spark, d), "ship").where("reasons = 'upstream-newer'").select("o")


@query(f"SELECT c_custkey AS o, CASE WHEN c_custkey % 200 < (SELECT max({CLOCK}) FROM orders) THEN 'upstream-newer' ELSE '' END AS reasons FROM customer")
def durable_newer_conservative(spark: SparkSession, d: str) -> DataFrame:
    pipeline, records = shop.calm(spark, d)
    return _of(plan(spark, pipeline, records), "late").select("o", "reasons")


@query(f"""WITH ship AS (SELECT o, recorded, own FROM ({SHIP})), chosen AS (SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 10 = 0),
 ships AS (SELECT s.* FROM ship s JOIN chosen c ON s.o = c.o WHERE s.recorded),
 stamps AS (SELECT r_name FROM (SELECT r_name, CASE WHEN row_number() OVER (ORDER BY r_name) <= 2 THEN 50 ELSE 1000 END AS own FROM region)
  WHERE (SELECT count(*) FROM ships) > 0 AND NOT coalesce((SELECT max(own) FROM ship WHERE recorded AND o NOT IN (SELECT o FROM ships)) > own, FALSE))
 SELECT 'order' AS rule, '[["o", "' || o || '"]]' AS kw_id FROM chosen UNION ALL SELECT 'ship', '[["o", "' || o || '"]]' FROM ships
 UNION ALL SELECT 'stamp', '[["region", "''' || r_name || '''"]]' FROM stamps""")
def cascade_settled(spark: SparkSession, d: str) -> DataFrame:
    """What is stamped along with every tenth order: its shipment, and the regions that no other shipment is newer than. The
    total stays: a region that is not stamped ran later than it."""
    pipeline, records = shop.shop(spark, d)
    found = plan(spark, pipeline, records)
    chosen = _of(found, "order").where("o % 10 = 0").select("rule", "kw_id")
    return cascade(spark, pipeline, found.by_rule, chosen).select("rule", "kw_id")


@query(f"SELECT o FROM ({ORDER}) WHERE status IS NULL OR status <> 2")
def upstream_failed_skip(spark: SparkSession, d: str) -> DataFrame:
    """The shipments that a run would not leave out for a failed order."""
    found = _planned(spark, d)
    return not_tainted(_of(found, "ship"), _of(found, "order").where("status = 2").select("kw_id"), True).select("o")


@query("""SELECT o_orderkey, count(*) AS outputs, bool_and(p_partkey IS NOT NULL) AS complete FROM orders JOIN lineitem ON o_orderkey = l_orderkey
 LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) ON p_partkey = l_partkey GROUP BY o_orderkey""")
def outputs_complete(spark: SparkSession, d: str) -> DataFrame:
    """A task is complete if it has outputs and a listing has them all (here: the parts that 10 does not divide)."""
    named = lambda c: [F.lit("parts").alias("folder"), F.col(c).cast("string").alias("name")]
    found = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), *named("l_partkey"), F.lit(None).cast("boolean").alias("checked"))
    there = _table(spark, d, "part").where("p_partkey % 10 <> 0").select(*named("p_partkey"))
    return outputs.completeness(found, there).select(F.col("key").alias("o_orderkey"), "outputs", "complete")


@query("""WITH needs AS (SELECT DISTINCT l_orderkey AS i, l_partkey % 7 AS x FROM lineitem), gives AS (SELECT o_orderkey AS i, o_custkey % 7 AS x FROM orders)
 SELECT n.i, count(*) FILTER (WHERE g.i IS NULL) = 0 AS proven FROM needs n LEFT JOIN gives g ON n.i = g.i AND n.x = g.x GROUP BY n.i""")
def elementwise_proof(spark: SparkSession, d: str) -> DataFrame:
    """Whether an element reads only what the upstream element with the same place gives."""
    needs = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_partkey") % 7).alias("x"))
    gives = _table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 7).alias("x"))
    return reports.proven_elements(needs, gives, "i", "x")


@query("""WITH RECURSIVE walk(n_nationkey, depth) AS (SELECT n_nationkey, 0::BIGINT FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, w.depth + 1 FROM walk w JOIN nation n ON n.n_nationkey // 2 = w.n_nationkey AND n.n_nationkey > 0)
 SELECT n_name AS rule, depth FROM walk JOIN nation USING (n_nationkey)""")
def rule_topology(spark: SparkSession, d: str) -> DataFrame:
    """The depth of each rule below the first ones, from the topological order."""
    return spark.createDataFrame(sorted(report.depths(shop.family(spark, d)).items()), "rule string, depth long")


@query(f"""SELECT row_number() OVER (ORDER BY topo, ord) AS place, rule, kw FROM (
 SELECT 0 AS topo, rule, ord, kw FROM ({GRID}) WHERE (ord + year) % 3 = 0
 UNION ALL SELECT 1, 'merge', n_nationkey, '{{"nation": "' || n_name || '"}}' FROM nation)""")
def runnable_order(spark: SparkSession, d: str) -> DataFrame:
    """Every runnable task with its place (the progress report's i of n): by rule, then place in the matrix."""
    pipeline, records = shop.grid(spark, d)
    return plan(spark, pipeline, records).placed().select("place", "rule", "kw")


PARTITION = f"""count(*) AS tasks, count(*) FILTER (WHERE status = 1 AND reasons = '') AS up_to_date, count(*) FILTER (WHERE status = 1 AND reasons <> '') AS stale,
 count(*) FILTER (WHERE status = 2) AS failed, count(*) FILTER (WHERE status IS NULL) AS pending, count(*) FILTER (WHERE reasons <> '') AS to_run FROM ({SHOP})"""


@query(f"SELECT rule, {PARTITION} GROUP BY rule")
def status_partition(spark: SparkSession, d: str) -> DataFrame:
    return report.state_counts(_planned(spark, d)).where("rule is not null")


@query(f"SELECT {PARTITION}")
def status_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.state_counts(_planned(spark, d)).where("rule is null").drop("rule")


@query(f"SELECT rule, category, count(*) AS n FROM (SELECT rule, unnest(string_split(reasons, '+')) AS category FROM ({SHOP}) WHERE reasons <> '') GROUP BY rule, category")
def reason_tally(spark: SparkSession, d: str) -> DataFrame:
    return report.reason_counts(_planned(spark, d))


@query(f"SELECT count(DISTINCT (code, uses, CASE WHEN io IS NULL THEN 9 ELSE io END)) AS versions FROM (SELECT o_custkey % 7 = 0 AS code, o_custkey % 11 = 0 AS uses, CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 13 = 0)::INT END AS io FROM orders WHERE o_orderkey % 10 <> 0)")
def code_versions(spark: SparkSession, d: str) -> DataFrame:
    """How many versions of code, declarations and specs the planner compares for a rule."""
    return versions(_of(_planned(spark, d), "order")).agg(F.count("*").alias("versions"))


# --- reports and lint ---

FAILURE = """'Traceback (most recent call last):' || chr(10) || '  File "run.py", line 10, in main' || chr(10) || '  File "' || CASE WHEN user_id % 2 = 0 THEN 'load.py' ELSE 'clean.py' END || '", line ' || (user_id % 3) || ', in step' || chr(10) || CASE WHEN user_id % 5 = 0 THEN 'KeyError' ELSE 'ValueError' END || ': value ' || event_id"""


@query("""SELECT CASE WHEN user_id % 5 = 0 THEN 'KeyError' ELSE 'ValueError' END AS type,
 CASE WHEN user_id % 2 = 0 THEN 'load.py' ELSE 'clean.py' END || ':' || (user_id % 3) || ':step' AS deepest, count(*) AS n, arg_min(user_id, event_id) AS example, min(event_id) AS first_seen
 FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def failure_groups(spark: SparkSession, d: str) -> DataFrame:
    errors = _table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.expr(FAILURE.replace("chr(10)", "char(10)")).alias("exception"))
    return reports.failure_groups(errors, "event_id", "exception", "user_id")


LINT = ["kind", "rule", "other_rule", "n", "example", "closest"]


@query("SELECT 'missing_dependency' AS kind, 'agg' AS rule, 'proc' AS other_rule, count(*) AS n, min('out/proc/' || n_name || '.txt') AS example, NULL::VARCHAR AS closest FROM nation")
def lint_missing_dependency(spark: SparkSession, d: str) -> DataFrame:
    """Inputs that another rule produces, though it is no declared dependency."""
    return report.lint(spark, shop.miswired(spark, d)).where("kind = 'missing_dependency'").select(*LINT)


@query("SELECT 'external' AS kind, 'agg' AS rule, NULL::VARCHAR AS other_rule, count(*) AS n, min('elsewhere/' || n_name || '.csv') AS example, NULL::VARCHAR AS closest FROM nation")
def lint_external(spark: SparkSession, d: str) -> DataFrame:
    return report.lint(spark, shop.miswired(spark, d)).where("kind = 'external'").select(*LINT)


@query("SELECT 'near_miss' AS kind, 'proc' AS rule, 'gen' AS other_rule, count(*) AS n, min('out/genn/' || n_name || '.txt') AS example, arg_min('out/gen/' || n_name || '.txt', 'out/genn/' || n_name || '.txt') AS closest FROM nation")
def lint_near_miss(spark: SparkSession, d: str) -> DataFrame:
    return report.lint(spark, shop.miswired(spark, d)).where("kind = 'near_miss'").select(*LINT)


@query("SELECT v.kind, v.rule, v.place::BIGINT AS place, (SELECT count(*) FROM nation) AS n FROM (VALUES ('near_miss', 'proc', 1), ('external', 'agg', 2), ('missing_dependency', 'agg', 3)) v(kind, rule, place)")
def lint_order(spark: SparkSession, d: str) -> DataFrame:
    """Findings in the order of the report: near misses come first."""
    found = report.lint(spark, shop.miswired(spark, d)).select("kind", "rule", "n").collect()  # a row for each kind, rule and other rule
    return spark.createDataFrame([(r.kind, r.rule, i + 1, r.n) for i, r in enumerate(found)], "kind string, rule string, place long, n long")


@query("SELECT event_type AS state, count(*) AS n, count(DISTINCT user_id % 7) AS reasons, array_to_string(list_sort(list(DISTINCT user_id % 7)), ',') AS listed FROM events GROUP BY 1")
def queue_states(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array_sort(F.collect_set(F.col("user_id") % 7))
    return _table(spark, d, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.size(listed).cast("long").alias("reasons"), F.array_join(listed.cast("array<string>"), ",").alias("listed"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM events GROUP BY 1")
def log_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = store.percentiles(_table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return found.select("event_type", *[F.round(p, 6).alias(p) for p in ("p50", "p90", "p99")], "most")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS array_index FROM part")
def job_array_index(spark: SparkSession, d: str) -> DataFrame:
    return store.array_index(_table(spark, d, "part"), "p_brand", ["p_retailprice", "p_partkey"]).select("p_brand", "p_partkey", "array_index")


@query("""SELECT user_id, batch, event_type, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS batch FROM (
 SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2, 3""")
def rule_batches(spark: SparkSession, d: str) -> DataFrame:
    return store.consecutive_batches(_table(spark, d, "events"), "event_type", "event_id", "user_id").groupBy("user_id", "batch", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KiB', n / 1024.0) WHEN n < 1073741824 THEN format('{:.1f} MiB', n / 1048576.0) ELSE format('{:.1f} GiB', n / 1073741824.0) END AS size
 FROM (SELECT o_orderkey, (o_orderkey % 5000) * (o_orderkey % 700) * (o_orderkey % 800) AS n FROM orders)""")
def size_labels(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("o_orderkey") % 5000) * (F.col("o_orderkey") % 700) * (F.col("o_orderkey") % 800)
    return _table(spark, d, "orders").select("o_orderkey", C.human_bytes(n).alias("size"))


@query("SELECT e.event_id AS key, e.user_id AS job, q.state FROM events e JOIN (SELECT user_id AS job, max(event_type) AS state FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING count(*) > 25) q ON q.job = e.user_id")
def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Recorded jobs that the queue still has, with their state there."""
    events = _table(spark, d, "events")
    queue = events.where("event_type in ('click', 'view')").groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("n"), F.max("event_type").alias("state")).where("n > 25")
    return reports.still_active(events.select(F.col("event_id").alias("key"), F.col("user_id").alias("job")), queue.select("job", "state"))


@query("SELECT event_id, CASE WHEN value > 50 THEN '{\"wall_s\":' || event_id % 97 || ',\"rss_method\":\"' || event_type || '\"}' ELSE '{\"rss_method\":\"' || event_type || '\"}' END AS value FROM events")
def resource_json(spark: SparkSession, d: str) -> DataFrame:
    """Resource fields as JSON; unknown ones are left out."""
    rows = _table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.col("event_id") % 97).alias("wall_s"), F.col("event_type").alias("rss_method"))
    return rows.select("event_id", F.to_json(F.struct("wall_s", "rss_method")).alias("value"))


# --- workloads ---


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line NOT LIKE 'The and a%'")
def comment_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return workloads.without_comments(lines, "line", "The and a")


@query("SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1")
def daily_mean(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


@query("""SELECT r_name AS site, n, printf('%.2f', mean_value) AS mean_value FROM (SELECT r_name, count(*) AS n, avg(v) AS mean_value FROM (
 SELECT c_nationkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey GROUP BY r_name)""")
def fan_in_report(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of several tasks concatenated, with a mean for each site."""
    both = _table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v")).unionByName(_table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")))
    placed = both.join(_table(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.groupBy(F.col("r_name").alias("site")).agg(F.count("*").alias("n"), F.format_string("%.2f", F.avg("v")).alias("mean_value"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - low) / nullif(high - low, 0), 4) AS scaled FROM lineitem
 JOIN (SELECT l_returnflag AS f, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON f = l_returnflag WHERE l_quantity > 10""")
def normalise_above_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return workloads.normalised_above(rows, "l_quantity", 10, ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("scaled", 4).alias("scaled"))


@query("SELECT l_returnflag, round(sum(l_quantity * v.factor), 2) AS calibrated, count(*) AS n FROM lineitem JOIN (VALUES ('A', 1.5), ('N', 0.5), ('R', 2.0)) v(flag, factor) ON flag = l_returnflag GROUP BY 1")
def calibrate_lookup(spark: SparkSession, d: str) -> DataFrame:
    factor = F.create_map(*[F.lit(x) for pair in (("A", 1.5), ("N", 0.5), ("R", 2.0)) for x in pair])
    rows = _table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") * F.try_element_at(factor, "l_returnflag")).alias("v")).where("v is not null")
    return rows.groupBy("l_returnflag").agg(F.round(F.sum("v"), 2).alias("calibrated"), F.count("*").alias("n"))


@query("""SELECT CASE WHEN m IN (12, 1, 2) THEN 'DJF' WHEN m IN (3, 4, 5) THEN 'MAM' WHEN m IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, (y + CASE WHEN m = 12 THEN 1 ELSE 0 END)::BIGINT AS season_year,
 round(avg(o_totalprice), 4) AS mean_price, count(*) AS n FROM (SELECT month(o_orderdate) AS m, year(o_orderdate) AS y, o_totalprice FROM orders) GROUP BY 1, 2""")
def seasonal_mean_djf(spark: SparkSession, d: str) -> DataFrame:
    return workloads.seasons(_table(spark, d, "orders").select("o_orderdate", "o_totalprice"), "o_orderdate").groupBy("season", "season_year").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, round(avg(m), 4) AS mean_of_means, count(*) AS groups FROM (SELECT o_orderpriority, year(o_orderdate) AS y, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    means = _table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("m"))
    return means.groupBy("o_orderpriority").agg(F.round(F.avg("m"), 4).alias("mean_of_means"), F.count("*").alias("groups"))


@query("SELECT sha1('pair:{''first'': ''' || a.n_name || ''', ''region'': ''' || r_name || ''', ''second'': ''' || b.n_name || '''}') AS key FROM (VALUES (0, 1), (2, 3), (5, 21), (8, 9)) v(i, j) JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j CROSS JOIN region")
def pair_selection(spark: SparkSession, d: str) -> DataFrame:
    """A sparse set of pairs, bound together, with every region."""
    names = {r.n_nationkey: r.n_name for r in _table(spark, d, "nation").select("n_nationkey", "n_name").collect()}
    regions = [r.r_name for r in _table(spark, d, "region").select("r_name").collect()]
    pair = Rule(lambda first, second, region: None, matrix={("first", "second"): [(names[i], names[j]) for i, j in ((0, 1), (2, 3), (5, 21), (8, 9))], "region": regions}, given_name="pair")
    return task_frame(spark, pair, 0).select("key")


@query("""SELECT o_orderkey, round(o_totalprice - m, 4) AS anomaly FROM orders LEFT JOIN (SELECT o_orderpriority AS p, avg(o_totalprice) AS m FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997 GROUP BY 1) ON p = o_orderpriority""")
def anomaly_vs_reference(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    return workloads.anomaly(orders, F.col("o_totalprice"), ["o_orderpriority"], F.year("o_orderdate").between(1996, 1997)).select("o_orderkey", F.round("anomaly", 4).alias("anomaly"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean_price, round(stddev_pop(l_extendedprice), 4) AS std_price, count(*) AS n FROM lineitem GROUP BY 1, 2")
def mean_std(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("std_price"), F.count("*").alias("n"))


@query("""SELECT id, round(100 * strength / total, 1) AS share, id = strongest AS is_strongest FROM (SELECT event_id AS id, value AS strength, user_id FROM events)
 JOIN (SELECT user_id AS u, sum(value) AS total, arg_max(event_id, value) AS strongest FROM events GROUP BY 1) ON u = user_id""")
def discovered_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each discovered event's share of its group to one decimal, and which is the strongest: of equal ones the least id, a null id
    never. Halves round away from zero as the SQL's do, after the product; shares of a group without strength are not finite."""
    events = _table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("strength"), "user_id")
    place = F.when(F.col("id").isNotNull() & F.col("strength").isNotNull(), F.struct("strength", F.bitwise_not("id")))
    groups = events.groupBy("user_id").agg(F.sum("strength").alias("total"), F.max_by("id", place).alias("strongest"))
    part = 100 * F.col("strength")
    whole = F.when(F.col("total") == 0, part * float("inf")).otherwise(part / F.col("total"))
    tens = F.round(whole * 10)
    share = F.when(F.abs(tens) == float("inf"), whole).otherwise(tens / 10)
    return events.join(groups, "user_id").select("id", share.alias("share"), (F.col("id") == F.col("strongest")).alias("is_strongest"))


@query("SELECT p_brand AS item, p // 32 AS at, sum(size)::BIGINT AS total FROM (SELECT p_brand, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p FROM part) GROUP BY 1, 2")
def pairwise_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Five chained stages of pairwise sums."""
    placed = store.array_index(_table(spark, d, "part"), "p_brand", ["p_partkey"]).select(F.col("p_brand").alias("item"), F.col("array_index").alias("at"), F.col("p_size").cast("long").alias("total"))
    return workloads.pairwise_sums(placed, "item", "at", "total", 5)
