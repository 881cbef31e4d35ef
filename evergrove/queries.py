"""The registered queries of the engine's own operators, each with its SQL.

Most are written in the path language and compiled; the rest use the DataFrame
operators directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrove.functions import columns as C
from evergrove.functions import model
from evergrove.operators import log as L
from evergrove.operators import templates, visibility
from evergrove.operators.collections import Collection
from evergrove.plans.compiler import Row, compile_row
from evergrove.plans.interpreter import Engine
from evergrove.plans.parser import parse_expression
from evergrove.streaming import reactive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: mount path: (table, key, ts, seq)
MOUNTS = {
    "world.users": ("events", "user_id", "ts", "event_id"),
    "world.events": ("events", "event_id", None, None),
    "world.orders": ("orders", "o_orderkey", None, None),
    "world.lineitem": ("lineitem", "l_orderkey", None, None),
    "world.customer": ("customer", "c_custkey", None, None),
    "world.supplier": ("supplier", "s_suppkey", None, None),
    "world.part": ("part", "p_partkey", None, None),
    "world.nation": ("nation", "n_nationkey", None, None),
    "world.region": ("region", "r_regionkey", None, None),
    "world.documents": ("documents", "doc_id", None, None),
    "world.embeddings": ("embeddings", "vec_id", None, None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Tables:
    """An engine's mounts, read when a query first names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, path: str) -> bool:
        return path in MOUNTS

    def __getitem__(self, path: str) -> Collection:
        name, key, ts, seq = MOUNTS[path]
        return Collection(table(self.spark, self.sf_dir, name), key, ts, seq)

    def get(self, path: str) -> Collection | None:
        return self[path] if path in self else None


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    found = Engine(spark)
    found.mounts = _Tables(spark, sf_dir)
    return found


def _register(name: str, function, oracle: str | None) -> None:
    QUERIES[name] = function
    if oracle is not None:
        ORACLES[name] = oracle


def text_query(name: str, text: str, oracle: str) -> None:
    """A query that is an expression of the language."""
    _register(name, lambda spark, sf_dir: engine(spark, sf_dir).query(text), oracle)


def derived(name: str, mount: str, keys: list[str], values: dict[str, str], oracle: str) -> None:
    """A collection's keys with computed expressions of the language."""

    def run(spark, sf_dir):
        collection = engine(spark, sf_dir).mounts[mount].now()
        row = Row(collection)
        cells = {n: compile_row(parse_expression(e), row) for n, e in values.items()}
        columns = [F.col(k) for k in keys]
        for n, cell in cells.items():
            columns.append(cell.value.alias(n))
            if cell.reason is not None:
                columns.append(cell.reason.alias(f"{n}__reason"))
        return collection.frame.select(*columns)

    _register(name, run, oracle)


def query(oracle: str | None = None):
    def register(function):
        _register(function.__name__, function, oracle)
        return function

    return register


# --- history and as-of reads ----------------------------------------------------

_NEWEST = "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events {where} GROUP BY user_id"

text_query("current_value", "world.users{user_id, value}", _NEWEST.format(where=""))
text_query("as_of_day", "world.users[@2024-01-15][value > 10]{user_id, value, ts}", """
SELECT user_id, value, ts FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(ts, (ts, event_id)) AS ts
FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id) WHERE value > 10""")
text_query("as_of_month", "world.users[@2024-01]{user_id, value}", _NEWEST.format(where="WHERE ts < TIMESTAMP '2024-02-01'"))
text_query("as_of_second", "world.users[@2024-01-10 12:30:15]{user_id, value}", _NEWEST.format(where="WHERE ts < TIMESTAMP '2024-01-10 12:30:16'"))
text_query("history_range", "world.users[@ >= @2024-01-05, @ < @2024-01-08]{event_id, user_id, value, ts}",
           "SELECT event_id, user_id, value, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (ts < TIMESTAMP '2024-01-02') AS value,
CASE WHEN count(*) FILTER (ts < TIMESTAMP '2024-01-02') = 0 THEN 'no value for world.users.' || user_id || ' as of 2024-01-01: no instance found at timestamp 1704153599999999 for path [world users ' || user_id || ']' END AS reason FROM events GROUP BY user_id""")
def as_of_before_first(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", "value")
    return L.as_of_or_unknown(rows, "user_id", model.parse_time("2024-01-01"), "ts", "event_id", "world.users").select("user_id", "value", "reason")


@query("SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events")
def history_chain(spark, sf_dir):
    return L.history(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "value", "age")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
WHERE b IS DISTINCT FROM event_type""")
def dedup_unchanged(spark, sf_dir):
    return L.suppress_unchanged(_events(spark, sf_dir), "user_id", "event_type", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT event_id, lag(event_id) OVER w AS previous_instance_id, strlen(event_type) AS size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def instance_meta(spark, sf_dir):
    return L.instance_meta(_events(spark, sf_dir), "user_id", "event_type", "ts", "event_id").select("event_id", "previous_instance_id", "size")


@query("SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events")
def validity_interval(spark, sf_dir):
    return L.instance_meta(_events(spark, sf_dir), "user_id", "value", "ts", "event_id").select("event_id", "ts", "valid_to")


@query("""SELECT p.event_id, p.user_id, arg_max(v.event_id, (v.ts, v.event_id)) AS right_event_id, arg_max(v.value, (v.ts, v.event_id)) AS right_value
FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id""")
def asof_join(spark, sf_dir):
    events = _events(spark, sf_dir)
    bought, seen = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.where("event_type = 'view'")
    return L.as_of_join(bought, seen, "user_id", ["event_id", "value"], "ts", "event_id").select("event_id", "user_id", "right_event_id", "right_value")


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20'")
def ttl_expired(spark, sf_dir):
    from datetime import datetime

    return L.expired(_events(spark, sf_dir), datetime(2024, 1, 20), F.expr("interval 10 days")).select("event_id", "user_id")


# --- the tree ---------------------------------------------------------------------


def _part_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("world.part."), "p_brand", F.lit("."), F.col("p_partkey").cast("string")).alias("path"))


@query("SELECT DISTINCT p_brand AS name FROM part")
def children_names(spark, sf_dir):
    return L.children(_part_paths(spark, sf_dir), "world.part")


@query("SELECT DISTINCT p_brand || '.' || p_partkey AS rest FROM part")
def subtree_paths(spark, sf_dir):
    return L.subtree_paths(_part_paths(spark, sf_dir), "world.part")


@query("SELECT DISTINCT p_brand || '.' || p_partkey AS rest FROM part")
def leaf_paths(spark, sf_dir):
    paths = _part_paths(spark, sf_dir)
    return L.leaf_paths(paths.unionAll(paths.select(F.regexp_extract("path", r"^(.*)\.[^.]*$", 1).alias("path"))), "world.part")


_NATION_FIELDS = ["n_name", "n_regionkey"]


@query("""SELECT 'world.nation.' || n_nationkey || '.n_name' AS path, 'n_name' AS name, n_name AS value FROM nation
UNION ALL SELECT 'world.nation.' || n_nationkey || '.n_regionkey', 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation""")
def explode_record(spark, sf_dir):
    return L.explode_record(table(spark, sf_dir, "nation"), "world.nation", "n_nationkey", _NATION_FIELDS)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def assemble_record(spark, sf_dir):
    return L.assemble_record(explode_record(spark, sf_dir), "world.nation", _NATION_FIELDS)


def _log(spark, sf_dir):
    path = F.concat(F.lit("world.users."), F.col("user_id").cast("string"), F.lit(".last_value"))
    return L.instances_of(table(spark, sf_dir, "events"), path, "ts", "event_id", "value", F.col("user_id"))


@query("""SELECT path, v_num FROM (SELECT 'world.users.' || user_id || '.last_value' AS path, arg_max(value, (ts, event_id)) AS v_num FROM events GROUP BY user_id)""")
def log_current(spark, sf_dir):
    return L.current(L.visible(_log(spark, sf_dir)), "path").select("path", "v_num")


@query("""SELECT 'world.users.' || user_id || '.last_value' AS path, event_id AS seq, value AS v_num FROM events
WHERE NOT (user_id BETWEEN 10 AND 19 AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20')""")
def purge_range(spark, sf_dir):
    from datetime import datetime
    from functools import reduce

    log = reduce(lambda frame, k: L.purge(frame, f"world.users.{k}", datetime(2024, 1, 10), datetime(2024, 1, 20)), range(10, 20), _log(spark, sf_dir))
    return L.visible(log).select("path", "seq", "v_num")


@query("""SELECT count(*) AS before, count(*) FILTER (NOT dead) AS after, count(*) FILTER (dead) AS dropped
FROM (SELECT ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AS dead FROM events)""")
def compaction(spark, sf_dir):
    from datetime import datetime

    return L.compaction_stats(L.purge(_log(spark, sf_dir), "world.users", datetime(2024, 1, 10), datetime(2024, 1, 20)))


@query("""SELECT 'my.part.' || p_partkey || '.name = "' || p_name || '"' AS line FROM part""")
def extract_script(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nulls = {"v_num": "double", "v_bool": "boolean", "v_time": "struct<ts:timestamp_ntz,prec:tinyint>", "v_money": "struct<amount:double,currency:string>", "v_json": "string"}
    log = part.select(F.concat(F.lit("my.part."), F.col("p_partkey").cast("string"), F.lit(".name")).alias("path"), F.lit("text").alias("kind"), F.col("p_name").alias("v_text"), *[F.lit(None).cast(t).alias(n) for n, t in nulls.items()])
    return log.select(F.concat("path", F.lit(" = "), L.literal_text()).alias("line"))


# --- brackets, projections, selectors ---------------------------------------------

text_query("filter_and", 'world.orders[o_totalprice > 100000, o_orderstatus = "F"]{o_orderkey, o_totalprice}',
           "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
text_query("filter_or", "world.orders[o_totalprice < 2000 or o_totalprice > 300000]{o_orderkey}",
           "SELECT o_orderkey FROM orders WHERE o_totalprice < 2000 OR o_totalprice > 300000")
text_query("filter_mixed", 'world.lineitem[l_quantity >= 30 and (l_returnflag = "R" or l_discount > 0.05)]{l_orderkey, l_linenumber}',
           "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND (l_returnflag = 'R' OR l_discount > 0.05)")
text_query("filter_not", 'world.orders[not (o_orderstatus = "F")]{o_orderkey}', "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
text_query("filter_not_equal", 'world.orders[o_orderpriority != "1-URGENT"]{o_orderkey}', "SELECT o_orderkey FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'")
text_query("filter_definite_eq", 'world.customer[c_mktsegment ?= "BUILDING"]{c_custkey}', "SELECT c_custkey FROM customer WHERE coalesce(c_mktsegment = 'BUILDING', false)")
text_query("filter_type_mismatch", "world.orders[o_orderstatus < 5]{o_orderkey}", "SELECT o_orderkey FROM orders WHERE false")
text_query("filter_time_eq_day", "world.orders[o_orderdate = @1996-03-13]{o_orderkey, o_orderdate}", "SELECT o_orderkey, o_orderdate FROM orders WHERE date_trunc('day', o_orderdate) = TIMESTAMP '1996-03-13'")
text_query("filter_time_eq_month", "world.orders[o_orderdate = @1996-03]{o_orderkey}", "SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = TIMESTAMP '1996-03-01'")
text_query("time_order_mixed", "world.orders[o_orderdate > @1996, o_orderdate <= @1997-06]{o_orderkey}", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'")
text_query("filter_then_project", "world.customer[c_acctbal < 0]{c_name, c_acctbal}", "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal < 0")
text_query("project_missing_field", "world.nation{n_name, population}", "SELECT n_name, CAST(NULL AS VARCHAR) AS population, 'not_found' AS population__reason FROM nation")
text_query("project_wildcard", "world.customer{c_*, not c_name}", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
text_query("project_exclusion", "world.region{*, not r_regionkey}", "SELECT r_name FROM region")
text_query("key_selector", 'world.supplier[2 + 3]{s_suppkey, s_name}', "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 5")
text_query("key_field", 'world.nation[key = "7"]{n_name, key}', "SELECT n_name, CAST(n_nationkey AS VARCHAR) AS key FROM nation WHERE n_nationkey = 7")


@query("""SELECT o_orderkey, quality IS NULL AS is_unknown, NOT coalesce(quality = 1, false) AS not_good FROM (
SELECT o_orderkey, l.quality FROM orders LEFT JOIN labels l ON l.doc_id = o_orderkey)""")
def match_unknown(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = table(spark, sf_dir, "orders").join(labels, F.col("o_orderkey") == F.col("doc_id"), "left")
    quality = C.Cell(F.col("quality").cast("double"), "number", F.when(F.col("quality").isNull(), F.lit("not_found")))
    row = Row(None, {"quality": quality})
    unknown = compile_row(parse_expression("quality ?= unknown"), row)
    good = compile_row(parse_expression("quality ?= 1"), row)
    return joined.select("o_orderkey", unknown.value.alias("is_unknown"), (~good.value).alias("not_good"))


@query("SELECT l_orderkey, l_linenumber, 'division by zero' AS reason FROM lineitem WHERE l_discount = 0")
def unknown_rows(spark, sf_dir):
    lines = engine(spark, sf_dir).mounts["world.lineitem"]
    test = compile_row(parse_expression("l_extendedprice / l_discount > 100000"), Row(lines))
    return lines.unknown_rows(test).select("l_orderkey", "l_linenumber", "reason")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def ref_deref(spark, sf_dir):
    mounts = engine(spark, sf_dir).mounts
    return mounts["world.nation"].dereference("n_regionkey", mounts["world.region"]).select("n_nationkey", "n_name", "r_name")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' AND source = 'src1'")
def stamp_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("stamp"))
    return visibility.with_stamp(visibility.with_stamp(docs, "stamp", "lang", "de"), "stamp", "source", "src1").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND NOT coalesce(source = 'src0', false)")
def stamp_filter(spark, sf_dir):
    """The same in the language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("stamp"))
    found = Engine(spark)
    found.mount("world.docs", docs, "doc_id")
    return found.query('world.docs[@stamp.lang = "fr", not (@stamp.source ?= "src0")]{doc_id}')


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') AS due, o_orderdate + INTERVAL 36 HOUR > TIMESTAMP '1998-01-01' AS late FROM orders")
def time_functions(spark, sf_dir):
    orders = engine(spark, sf_dir).mounts["world.orders"]
    row = Row(orders)
    due = compile_row(parse_expression('format_time(add_time(o_orderdate, 2, "months"), "yyyy-MM-dd")'), row)
    late = compile_row(parse_expression('add_time(o_orderdate, 36, "hours") > @1998-01-01 00:00:00'), row)
    return orders.frame.select("o_orderkey", due.value.alias("due"), late.value.alias("late"))


@query("SELECT c_custkey, c_name, n_name AS home, coalesce(c_mktsegment, 'none') AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def embed_record(spark, sf_dir):
    """Composition: the embedded record's fields, where the host has none."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    host, embedded = {"c_name": F.col("c_name"), "segment": F.col("c_mktsegment")}, {"segment": F.lit("none"), "home": F.col("n_name")}
    return joined.select("c_custkey", *[c.alias(n) for n, c in templates.inherit([host, embedded]).items()])


@query("SELECT user_id, event_id, ts FROM events WHERE user_id = 7")
def key_history(spark, sf_dir):
    """One child's history, newest first; the key test is on the scan."""
    users = engine(spark, sf_dir).mounts["world.users"]
    return L.history(users.frame.where("user_id = 7"), "user_id", "ts", "event_id").orderBy("age").select("user_id", "event_id", "ts")


# --- lists -----------------------------------------------------------------------

_VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
derived("list_index", "world.embeddings", ["vec_id"], {"third": "embedding[2]", "far": "embedding[1000]"},
        f"SELECT vec_id, {_VEC}[3] AS third, CAST(NULL AS VARCHAR) AS third__reason, CAST(NULL AS DOUBLE) AS far, 'list index 1000 out of bounds (length ' || len(embedding) || ')' AS far__reason FROM embeddings")
derived("coll_count", "world.documents", ["doc_id"], {"n": 'split(text, " ")..count'}, "SELECT doc_id, CAST(len(string_split(text, ' ')) AS DOUBLE) AS n FROM documents")
derived("coll_combine", "world.part", ["p_partkey"], {"c": 'split(p_name, " ")..combine("-")'}, "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '-') AS c FROM part")
derived("coll_append", "world.part", ["p_partkey"], {"c": 'split(p_name, " ")..append("end")..combine("|")'}, "SELECT p_partkey, array_to_string(list_append(string_split(p_name, ' '), 'end'), '|') AS c FROM part")
derived("coll_prepend", "world.part", ["p_partkey"], {"c": 'split(p_name, " ")..prepend("go")..combine("|")'}, "SELECT p_partkey, array_to_string(list_prepend('go', string_split(p_name, ' ')), '|') AS c FROM part")
derived("coll_remove_idx", "world.embeddings", ["vec_id"], {"n": "embedding..remove(0)..count", "first": "embedding..remove(0)[0]"},
        f"SELECT vec_id, CAST(len(embedding) - 1 AS DOUBLE) AS n, {_VEC}[2] AS first, CAST(NULL AS VARCHAR) AS first__reason FROM embeddings")
derived("coll_remove_val", "world.customer", ["c_custkey"], {"c": '["BUILDING", c_mktsegment, "x"]..remove("BUILDING")..combine(",")'}, "SELECT c_custkey, coalesce(c_mktsegment, '') || ',x' AS c FROM customer")
derived("coll_remove_range", "world.embeddings", ["vec_id"], {"n": "embedding..remove(1, 3)..count", "second": "embedding..remove(1, 3)[1]"},
        f"SELECT vec_id, CAST(len(embedding) - 3 AS DOUBLE) AS n, CAST(NULL AS VARCHAR) AS n__reason, {_VEC}[5] AS second, CAST(NULL AS VARCHAR) AS second__reason FROM embeddings")
derived("list_filter", "world.embeddings", ["vec_id"], {"positive": "embedding[item > 0]..count"}, f"SELECT vec_id, CAST(len(list_filter({_VEC}, lambda x: x > 0)) AS DOUBLE) AS positive FROM embeddings")
derived("list_map_reduce", "world.part", ["p_partkey"], {"total": "reduce(map([p_size, 2, 3], procedure(x): x * 2), procedure(a, x): a + x, 0)"},
        "SELECT p_partkey, CAST(p_size * 2 + 10 AS DOUBLE) AS total FROM part")
derived("list_range", "world.region", ["r_regionkey"], {"n": "(1..5)..count", "last": "(1..5)[4]"}, "SELECT r_regionkey, CAST(5 AS DOUBLE) AS n, CAST(NULL AS VARCHAR) AS n__reason, CAST(5 AS DOUBLE) AS last, CAST(NULL AS VARCHAR) AS last__reason FROM region")

# --- values ------------------------------------------------------------------------

derived("arith_div_zero", "world.lineitem", ["l_orderkey", "l_linenumber"], {"r": "l_extendedprice / l_discount"},
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS r, CASE WHEN l_discount = 0 THEN 'division by zero' END AS r__reason FROM lineitem")
derived("arith_mod", "world.lineitem", ["l_orderkey", "l_linenumber"], {"r": "l_quantity % 7"},
        "SELECT l_orderkey, l_linenumber, fmod(l_quantity, 7.0::DOUBLE) AS r, CAST(NULL AS VARCHAR) AS r__reason FROM lineitem")
derived("arith_pow", "world.part", ["p_partkey"], {"r": "2 ^ (p_size % 5) ^ 2", "big": "10 ^ (p_size * 100)"},
        "SELECT p_partkey, pow(2.0, pow(fmod(p_size::DOUBLE, 5.0::DOUBLE), 2.0)) AS r, CAST(NULL AS VARCHAR) AS r__reason, CASE WHEN p_size * 100 <= 308 THEN pow(10.0, p_size * 100.0) END AS big, CASE WHEN p_size * 100 > 308 THEN 'exponentiation result out of range' END AS big__reason FROM part")
derived("arith_mixed", "world.lineitem", ["l_orderkey", "l_linenumber"], {"net": "l_extendedprice * (1 - l_discount) + l_tax", "neg": "-l_quantity"},
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS net, CAST(NULL AS VARCHAR) AS net__reason, -l_quantity AS neg, CAST(NULL AS VARCHAR) AS neg__reason FROM lineitem")
derived("concat_coerce", "world.part", ["p_partkey"], {"t": 'p_name & "/" & p_size & "/" & (p_size > 10)'},
        "SELECT p_partkey, p_name || '/' || p_size || '/' || CASE WHEN p_size > 10 THEN 'true' ELSE 'false' END AS t FROM part")
derived("coerce_text_number", "world.documents", ["doc_id"], {"ok": 'number("12.5") + n_chars', "bad": "number(lang)"},
        "SELECT doc_id, 12.5::DOUBLE + n_chars AS ok, CAST(NULL AS VARCHAR) AS ok__reason, CAST(NULL AS DOUBLE) AS bad, 'cannot convert text to number: ' || lang AS bad__reason FROM documents")
derived("number_to_text", "world.lineitem", ["l_orderkey", "l_linenumber"], {"t": "text(l_quantity) & \" \" & text(l_discount)"},
        "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ' || CASE WHEN l_discount = 0 THEN '0' ELSE CAST(l_discount AS VARCHAR) END AS t FROM lineitem")
derived("truthiness", "world.lineitem", ["l_orderkey", "l_linenumber"], {"a": "l_discount and l_returnflag", "b": 'not l_discount or ""'},
        "SELECT l_orderkey, l_linenumber, l_discount <> 0 AND l_returnflag <> '' AS a, l_discount = 0 AS b FROM lineitem")
derived("str_case", "world.part", ["p_partkey"], {"u": "upper(p_name)", "l": "lower(p_type)", "t": 'trim("  " & p_brand & " ")'},
        "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, p_brand AS t FROM part")
derived("str_substring", "world.part", ["p_partkey"], {"s": "substring(p_name, 2, 4)", "out": "substring(p_name, 1000, 1)"},
        "SELECT p_partkey, substr(p_name, 3, 4) AS s, CAST(NULL AS VARCHAR) AS s__reason, CAST(NULL AS VARCHAR) AS out, 'invalid substring bounds: start=1000, length=1 for string of length ' || strlen(p_name) AS out__reason FROM part")
derived("str_find", "world.part", ["p_partkey"], {"f": 'find(p_name, "a")', "none": 'find(p_name, "~~")'},
        "SELECT p_partkey, CAST(instr(p_name, 'a') - 1 AS DOUBLE) AS f, -1::DOUBLE AS none FROM part")
derived("str_replace", "world.part", ["p_partkey"], {"r": 'replace(p_name, "a", "<a>")'}, "SELECT p_partkey, replace(p_name, 'a', '<a>') AS r FROM part")
derived("str_split", "world.part", ["p_partkey"], {"p": 'split(p_type, " ")[0]', "n": 'split("a.b|c", "|")..count'},
        "SELECT p_partkey, string_split(p_type, ' ')[1] AS p, CAST(NULL AS VARCHAR) AS p__reason, 2::DOUBLE AS n FROM part")
derived("str_len", "world.documents", ["doc_id"], {"bytes": "len(text)", "chars": "length(text)"}, "SELECT doc_id, strlen(text)::DOUBLE AS bytes, length(text)::DOUBLE AS chars FROM documents")
derived("str_interpolated", "world.nation", ["n_nationkey"], {"t": '~"nation {n_name} {{of}} {n_regionkey}"~'}, "SELECT n_nationkey, 'nation ' || n_name || ' {of} ' || n_regionkey AS t FROM nation")
derived("num_round", "world.customer", ["c_custkey"], {"r": "round(c_acctbal)", "f": "floor(c_acctbal)", "c": "ceil(c_acctbal)", "a": "abs(c_acctbal)"},
        "SELECT c_custkey, round(c_acctbal) AS r, CAST(NULL AS VARCHAR) AS r__reason, floor(c_acctbal) AS f, CAST(NULL AS VARCHAR) AS f__reason, ceil(c_acctbal) AS c, CAST(NULL AS VARCHAR) AS c__reason, abs(c_acctbal) AS a, CAST(NULL AS VARCHAR) AS a__reason FROM customer")
derived("num_minmax", "world.lineitem", ["l_orderkey", "l_linenumber"], {"hi": "max(l_quantity, l_tax, 10)", "lo": "min(l_quantity, 10)", "sum": "add(l_quantity, l_tax, 1)"},
        "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax, 10) AS hi, CAST(NULL AS VARCHAR) AS hi__reason, least(l_quantity, 10) AS lo, CAST(NULL AS VARCHAR) AS lo__reason, 0.0 + l_quantity + l_tax + 1.0 AS sum, CAST(NULL AS VARCHAR) AS sum__reason FROM lineitem")
derived("type_of", "world.orders", ["o_orderkey"], {"a": "type_of(o_totalprice)", "b": "type_of(o_orderdate)", "c": "type_of(1 / 0)", "d": "is_unknown(1 / 0)"},
        "SELECT o_orderkey, 'number' AS a, 'time' AS b, 'unknown' AS c, true AS d FROM orders")
derived("time_format_precision", "world.orders", ["o_orderkey"], {"d": 'text(parse_time("1996-03")) & " " & text(o_orderdate)'},
        "SELECT o_orderkey, '1996-03 ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d FROM orders")
derived("list_compare", "world.part", ["p_partkey"], {"a": "[p_size, 2] < [p_size, 3]", "b": "[p_size % 2, 2] = [1, 2]", "c": "[p_size % 3, 2] < [1, p_size]", "d": "[p_size] < [7, 1]"},
        "SELECT p_partkey, true AS a, p_size % 2 = 1 AS b, CAST(NULL AS VARCHAR) AS b__reason, p_size % 3 < 1 OR (p_size % 3 = 1 AND 2 < p_size) AS c, CAST(NULL AS VARCHAR) AS c__reason, p_size <= 7 AS d FROM part")
derived("procedure_inline", "world.part", ["p_partkey"], {"b": "map([p_size], procedure(x): x * x)[0]"},
        "SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS b, CAST(NULL AS VARCHAR) AS b__reason FROM part")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_parse(spark, sf_dir):
    parsed = compile_row(parse_expression("parse_json(props)"), Row(Collection(table(spark, sf_dir, "events"))))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(parsed.value, "$.k", "double").alias("k"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS j FROM nation""")
def json_roundtrip(spark, sf_dir):
    record = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.try_parse_json(F.to_json(record))).alias("j"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal > 1000 ELSE false END AS richer, -s_acctbal AS owed,
printf('%.2f', s_acctbal) || CASE WHEN s_nationkey % 2 = 0 THEN ' USD' ELSE ' EUR' END AS shown FROM supplier""")
def money_compare(spark, sf_dir):
    currency = F.when(F.col("s_nationkey") % 2 == 0, F.lit("USD")).otherwise(F.lit("EUR"))
    balance = C.Cell(F.struct(F.col("s_acctbal").alias("amount"), currency.alias("currency")), "money")
    more = C.compare(">", balance, C.literal(model.Money(1000.0, "USD")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", more.value.alias("richer"), C.minus(balance).value["amount"].alias("owed"), C.to_text(balance).value.alias("shown"))


@query("""SELECT o_orderkey, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month, day(o_orderdate) AS day,
CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday, o_orderdate + INTERVAL 45 DAY AS due FROM orders""")
def time_parts(spark, sf_dir):
    at = F.col("o_orderdate")
    ints = {"year": F.year(at), "quarter": F.quarter(at), "month": F.month(at), "day": F.day(at)}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", *[c.cast("long").alias(n) for n, c in ints.items()], F.dayofweek(at).alias("weekday"), (at + F.make_dt_interval(F.lit(45))).cast("timestamp_ntz").alias("due")
    )


# --- templates, cascade, visibility ---------------------------------------------------


@query("SELECT p_partkey, p_name, coalesce(p_brand, 'none') AS p_brand, 0.0::DOUBLE AS p_retailprice, 'new' AS state FROM part")
def template_new(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return templates.from_template(part, {"p_brand": "none", "state": "new"}, {"p_size": ("exclude", None), "p_retailprice": ("reset", 0.0)})


@query("""SELECT c_custkey, coalesce(c_name, n_name) AS name, n_name AS home, 'customer' AS _type FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def inherit_merge(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    merged = templates.inherit([{"name": F.col("c_name")}, {"name": F.col("n_name"), "home": F.col("n_name")}], {"_type": F.lit("customer")})
    return joined.select("c_custkey", *[c.alias(n) for n, c in merged.items()])


@query("""SELECT 'world.r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey AS path,
CASE WHEN n_nationkey % 3 = 0 THEN 'nation' WHEN n_regionkey < 3 THEN 'region' ELSE 'world' END AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def cascade_nearest(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    region_path = F.concat(F.lit("world.r"), F.col("n_regionkey").cast("string"))
    nation_path = F.concat(region_path, F.lit(".n"), F.col("n_nationkey").cast("string"))
    named = lambda owner, value: [owner.alias("owner"), F.lit("tax").alias("name"), F.lit(value).alias("value")]
    settings = nation.where("n_nationkey % 3 = 0").select(*named(nation_path, "nation"))
    settings = settings.unionAll(nation.where("n_regionkey < 3").select(*named(region_path, "region")).distinct()).unionAll(spark.range(1).select(*named(F.lit("world"), "world")))
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    paths = joined.select(F.concat(nation_path, F.lit(".c"), F.col("c_custkey").cast("string")).alias("path"))
    return templates.cascade_nearest(paths, settings).select("path", "value")


_PERMITTED = """SELECT 'world.' || c_mktsegment || '.' || c_custkey AS path, {rule} AS allowed FROM customer"""


def _grants(spark):
    grants = [("world.BUILDING", "write", '["ann","bob"]'), ("world.MACHINERY", "write", "(Anything)"), ("world.BUILDING.7", "write", "(Nothing)"), ("world.FURNITURE", "read", "bob")]
    return spark.createDataFrame(grants, "owner string, permission string, condition string")


def _segment_paths(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("world."), F.col("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string")).alias("path"))


@query(_PERMITTED.format(rule="(c_mktsegment = 'BUILDING' AND c_custkey <> 7) OR c_mktsegment = 'MACHINERY'"))
def perm_effective(spark, sf_dir):
    return visibility.effective_permission(_segment_paths(spark, sf_dir), _grants(spark), "write", "ann", 1).select("path", "allowed")


@query(_PERMITTED.format(rule="c_mktsegment <> 'FURNITURE'"))
def perm_default(spark, sf_dir):
    return visibility.effective_permission(_segment_paths(spark, sf_dir), _grants(spark), "read", "ann", 1).select("path", "allowed")


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'row' ELSE 'site' END AS owner, coalesce(source, '') AS source, 'eu' AS zone FROM documents""")
def stamp_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    site = F.create_map(F.lit("owner"), F.lit("site"), F.lit("zone"), F.lit("eu"))
    own = F.when(F.col("lang") == "en", F.create_map(F.lit("owner"), F.lit("row"))).otherwise(F.create_map().cast("map<string,string>"))
    host = F.create_map(F.lit("source"), F.coalesce("source", F.lit("")))
    stamp = visibility.embedded_stamp(host, [visibility.merged_stamps(site, own)], ("source",))
    return docs.select("doc_id", stamp["owner"].alias("owner"), stamp["source"].alias("source"), stamp["zone"].alias("zone"))


@query("SELECT doc_id FROM documents WHERE NOT (lang IN ('de', 'fr') AND source = 'src0')")
def filter_hide(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("stamp"))
    return visibility.hide(docs, F.col("stamp"), visibility.parse_filter({"lang": ["de", "fr"], "f": "source ?= 'src0'"})).select("doc_id")


# --- ticks and watchers ------------------------------------------------------------

_TICK = "epoch_us(ts) // 333000"
_DAY_MS = 86_400_000


@query(f"SELECT {_TICK} AS tick, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def tick_last_wins(spark, sf_dir):
    return reactive.last_per_tick(_events(spark, sf_dir), ["event_type"], "ts", "event_id").select("tick", "event_type", "value")


def _changes(spark, sf_dir):
    events = _events(spark, sf_dir)
    path = F.concat(F.lit("world.users."), F.col("user_id").cast("string"), F.lit("."), F.col("event_type"))
    return events.withColumn("tick", reactive.tick_of(F.col("ts"), _DAY_MS)).withColumn("path", path)


@query("""SELECT DISTINCT epoch_us(ts) // 86400000000 AS tick, n AS name FROM events, (VALUES ('all', -1, ''), ('seven', 7, ''), ('nine_view', 9, 'view')) w(n, u, t)
WHERE (u = -1 OR user_id = u) AND (t = '' OR event_type = t)""")
def watcher_trigger(spark, sf_dir):
    registry = spark.createDataFrame(
        [("all", ["world.users"], True), ("seven", ["world.users.7", "world.users.7.view"], True), ("nine_view", ["world.users.9.view"], True), ("off", ["world"], False)],
        "name string, watching array<string>, enabled boolean",
    )
    return reactive.triggers(_changes(spark, sf_dir), registry)


@query("""SELECT epoch_us(ts) // 86400000000 AS tick, user_id, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY ts, event_id), ',') AS items
FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY ALL""")
def watcher_append(spark, sf_dir):
    found = reactive.appended_items(_changes(spark, sf_dir), (F.col("event_type") == "purchase") & (F.col("value") > 20), F.col("event_id").cast("string"), ["user_id"], "ts", "event_id")
    return found.select("tick", "user_id", F.array_join("items", ",").alias("items"))


@query("""WITH c AS (SELECT epoch_us(ts) // 86400000000 AS tick, user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL),
d AS (SELECT tick + 1 AS tick, user_id, n * 2 AS n FROM c WHERE n > 1), e AS (SELECT tick + 1 AS tick, user_id, n + 1 AS n FROM d)
SELECT *, 0 AS round FROM c UNION ALL SELECT *, 1 FROM d UNION ALL SELECT *, 2 FROM e""")
def watcher_cascade(spark, sf_dir):
    source = _changes(spark, sf_dir).where("event_type = 'purchase'").groupBy("tick", "user_id").agg(F.count("*").alias("n"))
    first = lambda rows: rows.where("n > 1").select("tick", "user_id", (F.col("n") * 2).alias("n"))
    second = lambda rows: rows.select("tick", "user_id", (F.col("n") + 1).alias("n"))
    return reactive.cascade(source, [(first, "double"), (second, "sink")])


@query(f"""SELECT {_TICK} AS tick, event_id, user_id FROM events WHERE {_TICK} NOT IN (SELECT {_TICK} FROM events WHERE event_type = 'error')""")
def tick_rollback(spark, sf_dir):
    changes = _events(spark, sf_dir).withColumn("tick", reactive.tick_of(F.col("ts")))
    return reactive.rolled_back(changes, F.col("event_type") == "error").select("tick", "event_id", "user_id")


@query("SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def running_counter(spark, sf_dir):
    return reactive.running_count(_events(spark, sf_dir), ["event_type"], "ts", "event_id").select("event_id", "event_type", "running")


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def push_channel(spark, sf_dir):
    return reactive.latest_per_stream(_events(spark, sf_dir), "event_type", "ts", "event_id").select("event_type", "value")


@query("SELECT event_id, 's' || k AS subscriber FROM events, (VALUES (1), (2)) s(k) WHERE (k = 1 AND event_type = 'view') OR (k = 2 AND event_type IN ('view', 'click'))")
def subscription_fanout(spark, sf_dir):
    subscriptions = spark.createDataFrame([("view", "s1"), ("view", "s2"), ("click", "s2")], "path string, subscriber string")
    return reactive.subscribers(_events(spark, sf_dir), subscriptions, "event_type").select("event_id", "subscriber")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_time_window(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("value", F.col("value"))
    return reactive.windowed(events, "ts", "1 day", ["event_type"], n=F.count("*"), total=F.sum("value")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""SELECT 'my.computer.network.web.requests.' || page_id || '.' || n AS path, n AS name, CASE n WHEN 'method' THEN 'GET' WHEN 'host' THEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS value FROM pages, (VALUES ('method'), ('host'), ('route')) f(n)""")
def request_queue(spark, sf_dir):
    return reactive.request_records(table(spark, sf_dir, "pages"), "page_id", "url")


# --- sources -------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation")
def xml_import(spark, sf_dir):
    from evergrove.sources.xml import parse_column, to_column

    nation = table(spark, sf_dir, "nation").select(to_column(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), "nation").alias("xml"))
    parsed = nation.select(parse_column(F.col("xml"), "key int, name string").alias("r"))
    return parsed.select(F.col("r.key").alias("n_nationkey"), F.col("r.name").alias("n_name"))


@query("SELECT r_regionkey, '<region><key>' || r_regionkey || '</key><name>' || r_name || '</name></region>' AS xml FROM region")
def xml_export(spark, sf_dir):
    from evergrove.sources.xml import to_column

    xml = to_column(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "region")
    return table(spark, sf_dir, "region").select("r_regionkey", F.regexp_replace(xml, r"\s*\n\s*", "").alias("xml"))


_REPORT = '''section report:
    field key: right 5 same: "KEY:"
    section lines starts("BEGIN") ends("END"):
        field kind: right 6 same: "KIND:"
        field amount: right 8 same: "AMOUNT:" money
        break
    field total: right 7 same: "TOTAL:" money'''


@query("""SELECT o_orderkey AS id, '{"report":{"key":' || o_orderkey || ',"lines":[{"amount":' || o_custkey || ',"kind":"A"},{"amount":2,"kind":"B"}],"total":' || (o_custkey + 2) || '}}' AS record FROM orders""")
def ari_extract(spark, sf_dir):
    from evergrove.sources.ari import extract_reports

    key, amount = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    lines = [F.concat(F.lit("KEY: "), key), F.lit("BEGIN"), F.concat(F.lit("KIND: A AMOUNT: $"), amount, F.lit(".00")), F.lit("KIND: B AMOUNT: $2.00"), F.lit("END"), F.concat(F.lit("TOTAL: $"), (F.col("o_custkey") + 2).cast("string"), F.lit(".00"))]
    reports = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", *lines).alias("report"))
    return extract_reports(reports, _REPORT, "o_orderkey", "report")


# --- extensions: what the language leaves to DataFrames ----------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, avg(l_discount) AS discount, count(*) AS n FROM lineitem GROUP BY ALL")
def ext_groupby(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment")
def ext_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.sum("k").alias("n"))


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def ext_topk(spark, sf_dir):
    from pyspark.sql import Window

    ranked = table(spark, sf_dir, "orders").withColumn("r", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long"))
    return ranked.where("r <= 2").select("o_custkey", "o_orderkey", "r")


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def ext_setops(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


FLAGSHIP = "as_of_day"
