"""Visibility, reactive layer, sources, and the registered queries."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from evergrove.functions.model import Unknown
from evergrove.operators import log as L
from evergrove.operators import visibility as V
from evergrove.operators.placement import cuts_passed
from evergrove.plans.interpreter import Engine
import evergrove.queries_programs  # noqa: F401
from evergrove.queries import ORACLES, QUERIES
from evergrove.sources import ari, files, xml
from evergrove.streaming import reactive as R

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    def plain(x):
        return "NULL" if x is None or x != x else repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    names = sorted(frame[0])
    return sorted(tuple(plain(v) for v in row) for row in zip(*(frame[1][n] for n in names)))


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    mine = QUERIES[name](spark, SF)
    found = [r.asDict() for r in mine.collect()]
    other = oracle.execute(ORACLES[name])
    columns = [d[0] for d in other.description]
    theirs = other.fetchall()
    assert sorted(mine.columns) == sorted(columns)
    left = rows_of((columns, {c: [r[c] for r in found] for c in columns}))
    right = rows_of((columns, {c: [r[k] for r in theirs] for k, c in enumerate(columns)}))
    assert left == right


def test_stamps(spark):
    frame = spark.sql("select map('a', '1', 'b', '1') host, map('b', '2', 'c', '2') low, map('c', '3', '@author', 'x') high")
    merged = frame.select(V.embedded_stamp(F.col("host"), [F.col("low"), F.col("high")], ("@author",)).alias("s")).first()["s"]
    assert merged == {"a": "1", "b": "1", "c": "3"}


def test_filters_hide_only_full_matches(spark):
    frame = spark.createDataFrame([(1, {"lang": "de"}), (2, {"lang": "de", "src": "x"}), (3, {})], "id long, stamp map<string,string>")
    assert {r["id"] for r in V.hide(frame, F.col("stamp"), {"lang": ["de", "fr"], "src": "x"}).collect()} == {1, 3}
    assert V.hide(frame, F.col("stamp"), {}).count() == 3


def test_permission_defaults(spark):
    paths = spark.createDataFrame([("world.agent.1.x",), ("world.agent.2.x",), ("other.x",)], "path string")
    grants = spark.createDataFrame([("world.agent.2", "write", "(Anything)")], "owner string, permission string, condition string")
    found = {r["path"]: r["allowed"] for r in V.effective_permission(paths, grants, "write", "ann", 1).collect()}
    assert found == {"world.agent.1.x": True, "world.agent.2.x": True, "other.x": False}


@pytest.fixture
def reactor(spark):
    return R.Reactor(Engine(spark))


def test_cascade_takes_a_tick_per_link(reactor):
    reactor.write("watch first (my.source): my.middle = my.source + 1\nwatch second (my.middle): my.sink = my.middle * 2")
    reactor.write("my.source = 5")
    assert reactor.tick() == ["first"]
    assert reactor.tick() == ["second"]
    assert reactor.tick() == []
    assert reactor.engine.execute("my.sink") == 12.0


def test_tick_rolls_back_and_retries(reactor):
    reactor.write("watch a (my.s): my.out = 1\nwatch b (my.s): 1 / my.s")
    reactor.write("my.s = 0")
    assert reactor.tick() == [] and reactor.problems == ["b: division by zero"]
    assert isinstance(reactor.engine.execute("my.out"), Unknown)
    reactor.write("my.s = 2")
    assert sorted(reactor.tick()) == ["a", "b"]
    assert reactor.engine.execute("my.out") == 1.0


@pytest.mark.parametrize("order", ["see touch", "touch see"])
def test_watchers_of_a_tick_do_not_see_each_other(reactor, order):
    reactor.write("my.out = 7")
    bodies = {"see": "watch see (my.s): my.seen = my.out", "touch": "watch touch (my.s): my.out = 1"}
    reactor.write("\n".join(bodies[name] for name in order.split()))
    reactor.write("my.s = 1")
    assert sorted(reactor.tick()) == ["see", "touch"]
    assert reactor.engine.execute("my.seen") == 7.0 and reactor.engine.execute("my.out") == 1.0


def test_append_watcher_sees_all_items(reactor):
    reactor.write("log.w: watch append (my.events[value > 10]) as items: my.seen = items..count")
    for value in (5.0, 11.0, 12.0):
        reactor.append("my.events", {"value": value})
    assert reactor.tick() == ["log.w"]
    assert reactor.engine.execute("my.seen") == 2.0


def test_quiet_changes_do_not_trigger(reactor):
    reactor.write("watch a (my.s): my.out = 1")
    reactor.write("my.s = (quietly) 3")
    assert reactor.tick() == []


def test_endless_cascade_is_stopped(reactor, monkeypatch):
    monkeypatch.setattr(R, "MAX_CASCADE", 5)
    reactor.write("watch a (my.n): my.n = my.n + 1")
    reactor.write("my.n = 1")
    reactor.settle()
    assert reactor.problems and "cascade exceeded" in reactor.problems[0]


def test_stream_ticks_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = R.watch_stream(stream, lambda batch, k: seen.append((k, batch.count())), str(tmp_path / "check"), available_now=True)
    query.awaitTermination(120)
    assert len(seen) == 3 and sum(n for _, n in seen) == events.count()


def test_stream_suppresses_unchanged(spark, tmp_path):
    schema = "k long, ts timestamp_ntz, seq long, v string"
    for n, rows in enumerate([[(1, datetime(2024, 1, 1), 1, "a"), (1, datetime(2024, 1, 2), 2, "a")], [(1, datetime(2024, 1, 3), 3, "a"), (1, datetime(2024, 1, 4), 4, "b")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changed = R.changed_values(stream, "k", "v", "ts", "seq")
    query = changed.writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted(r["seq"] for r in spark.table("changed").collect()) in ([1, 4], [1, 3, 4])


def test_as_of_join_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, datetime(2024, 1, 1), 1), (2, datetime(2024, 1, 1), 2)], "k long, ts timestamp_ntz, seq long")
    right = spark.createDataFrame([(1, datetime(2024, 1, 1), 9, 5.0)], "k long, ts timestamp_ntz, seq long, v double")
    found = {r["k"]: r["right_v"] for r in L.as_of_join(left, right, "k", ["v"]).collect()}
    assert found == {1: 5.0, 2: None}


REPORT = """BANK REPORT 2024-03-15
ID: 12345
==== transactions ====
TYPE: DEBIT  AMOUNT: $1,500.00  TAX: $45.00
TYPE: CREDIT AMOUNT: $2,000.00  TAX: $0.00
==== end of transactions ====
TOTAL: $500.00"""
SPEC = """section bank_report:
    field report_date: right 12 same: "BANK REPORT"
    field bank_id: right 4 same: "ID:"

    section transactions starts("==== transactions ====") ends("==== end of transactions ===="):
        field transaction_type: right 6 same: "TYPE:"
        field amount: right 8 same: "AMOUNT:"
        field tax: right 5 same: "TAX:"
        break

    field total: right 7 same: "TOTAL:"
    field missing: right 1 same: "NOPE:"
"""


def test_report():
    found = ari.extract(ari.parse_specification(SPEC), REPORT)["bank_report"]
    assert found["bank_id"] == 12345.0 and found["total"] == 500.0 and found["missing"] == Unknown("not_found")
    assert found["report_date"].precision == 3
    assert found["transactions"] == [{"transaction_type": "DEBIT", "amount": 1500.0, "tax": 45.0}, {"transaction_type": "CREDIT", "amount": 2000.0, "tax": 0.0}]


def test_report_break_on_and_moves():
    spec = 'section all:\n    section item starts("ITEM") ends("END"):\n        field name: down 1 flush: "ITEM"\n    section rows:\n        field code: integer\n        break on "ITEM"\n'
    found = ari.extract(ari.parse_specification(spec), "ITEM 1\nfoo x\nEND\nITEM 2\nbar\nEND")["all"]
    assert found["item"] == [{"name": "foo"}, {"name": "bar"}]
    assert found["rows"] == [{"code": 1.0}, {"code": 2.0}]


def test_xml_records():
    record = xml.to_record('<report date="d"><header><bank>B</bank></header><t id="T1"><x>1</x></t><t id="T2"/></report>')
    assert record == {"date": "d", "header": {"bank": {"_text": "B"}}, "t": [{"id": "T1", "x": {"_text": "1"}}, {"id": "T2"}]}
    assert xml.from_record({"a": "<&>", "l": ["1", "2"]}, "r") == "<r><a>&lt;&amp;&gt;</a><l>1</l><l>2</l></r>"
    assert isinstance(xml.to_record("<a>"), Unknown)


def test_files(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for form in ("json", "csv", "tsv"):
        path = str(tmp_path / form)
        files.write(frame, path, form)
        back = {"json": files.read_json, "csv": files.read_csv, "tsv": files.read_tsv}[form](spark, path, "k long, v string")
        assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]
        assert files.exists(spark, path) and files.file_table(spark, path).count() >= 1
        assert files.delete(spark, path) and not files.exists(spark, path)
    (tmp_path / "t.toml").write_text('[a]\nb = 1\n')
    assert files.read_toml(spark, str(tmp_path / "t.toml")).first()["document"] == '{"a": {"b": 1}}'
    path = str(tmp_path / "x")
    xml.write_xml(frame, path, "row")
    assert sorted(map(tuple, xml.read_xml(spark, path, "row", "k long, v string").collect())) == [(1, "a"), (2, "b")]


def test_stream_forgets_keys_behind_the_watermark(spark, tmp_path):
    """With a watermark the state of quiet keys goes; their next value is a first one."""
    schema = "k long, ts timestamp, seq long, v string"
    day = lambda d: datetime(2024, 1, d)
    batches = [[(1, day(1), 1, "a"), (2, day(1), 2, "x")], [(2, day(9), 3, "y")], [(2, day(10), 4, "y")], [(1, day(10), 5, "a"), (2, day(10), 6, "y")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = {}
    for name, watermark in (("kept", None), ("forgotten", "1 day")):
        changed = R.changed_values(stream, "k", "v", "ts", "seq", watermark)
        query = changed.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(180)
        found[name] = sorted(r["seq"] for r in spark.table(name).collect())
    assert found == {"kept": [1, 2, 3], "forgotten": [1, 2, 3, 5]}


def test_running_count_of_one_key(spark):
    """One key holds nearly all rows: the ranges split it, nulls and ties included."""
    rows = [("a" if k % 50 else "b", None if k % 97 == 0 else datetime(2024, 1, 1 + k % 28), k, k) for k in range(3000)] + [(None, datetime(2024, 1, 1), 1, -1)]
    frame = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq long, id long")
    frame.createOrReplaceTempView("running_rows")
    want = spark.sql("select id, count(*) over (partition by key order by ts, seq rows unbounded preceding) as running from running_rows")
    for ranges in (1, 2, 40):
        assert sorted(R.running_count(frame, ["key"], "ts", "seq", ranges).select("id", "running").collect()) == sorted(want.collect())
    assert R.running_count(frame.limit(0), ["key"], "ts", "seq").count() == 0
    cuts = [1, 1, 5, 9, 9, 20][1:]
    numbers = spark.range(-2, 25).withColumn("passed", cuts_passed(F.col("id"), cuts))
    assert [r["passed"] for r in numbers.orderBy("id").collect()] == [sum(c <= k for c in cuts) for k in range(-2, 25)]


def test_triggers_join_before_they_are_distinct(spark):
    changes = spark.createDataFrame([(1, "a.b.c"), (1, "a.b.d"), (2, "x"), (2, "a.b.c")], "tick long, path string")
    registry = spark.createDataFrame([("w", ["a.b"], True), ("v", ["a.b.c", "x"], True), ("off", ["a"], False)], "name string, watching array<string>, enabled boolean")
    found = R.triggers(changes, registry)
    assert sorted(map(tuple, found.collect())) == [(1, "v"), (1, "w"), (2, "v"), (2, "w")]


@pytest.mark.parametrize("ranges", [1, 3, 25])
def test_histories_in_ranges_are_whole_histories(spark, ranges):
    """One key holds nearly all rows; times tie, and some are null."""
    rows = [("hot" if k % 40 else f"k{k % 3}", None if k % 101 == 0 else datetime(2024, 1, 1 + k * 7 % 28), k, ("abc"[k // 5 % 3] if k % 11 else None), k % 4) for k in range(2000)] + [(None, datetime(2024, 1, 1), 1, "a", 0)]
    log = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq long, value string, n int")
    same = lambda f: sorted(map(str, f(ranges).collect())) == sorted(map(str, f(None).collect()))
    assert same(lambda r: L.history(log, "key", ranges=r))
    assert same(lambda r: L.suppress_unchanged(log, "key", "value", ranges=r))
    assert same(lambda r: L.instance_meta(log, "key", "value", ranges=r))
    left, right = log.where("n > 1 and ts is not null"), log.where("n <= 1 and ts is not null")
    assert same(lambda r: L.as_of_join(left, right, "key", ["seq", "value"], ranges=r))
    assert L.history(log.limit(0), "key", ranges=ranges).count() == 0


def test_ticks_of_a_stream_cascade_and_roll_back(spark, tmp_path):
    """Every file is a tick; one with a failed row leaves nothing."""
    schema = "path string, ts timestamp_ntz, seq long, value double"
    for n, values in enumerate([[1.0, 2.0], [3.0, -1.0], [4.0]]):
        rows = [(f"a.b.k{k}", datetime(2024, 1, 1), 10 * n + k, v) for k, v in enumerate(values)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    registry = spark.createDataFrame([("w", ["a.b"], True), ("c", ["copy"], True), ("k1", ["a.b.k1"], True)], "name string, watching array<string>, enabled boolean")
    links = [(lambda changes: changes.withColumn("path", F.concat(F.lit("copy."), "path")), "copy")]
    R.tick_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), registry, F.col("value") < 0, links, available_now=True).awaitTermination(180)
    changes = spark.read.parquet(str(tmp_path / "out/changes"))
    assert sorted((r["path"], r["value"], r["round"]) for r in changes.collect()) == sorted((p + f"a.b.k{k}", v, len(p) // 5) for p in ("", "copy.") for k, v in ((0, 1.0), (1, 2.0), (0, 4.0)))
    found = {(r["name"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out/triggered")).collect()}
    assert found == {("w", 0), ("k1", 0), ("c", 0), ("w", 2), ("c", 2)}


def test_a_reactor_fed_by_a_stream(spark, reactor, tmp_path):
    for n in range(3):
        spark.createDataFrame([("world.in.x", float(n)), (f"world.in.y{n}", 1.0)], "path string, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    reactor.write("watch count (world.in): my.n = world.in..count\nwatch then (my.n): my.twice = my.n * 2")
    stream = spark.readStream.schema("path string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    R.react_stream(stream, reactor, str(tmp_path / "c"), available_now=True).awaitTermination(180)
    assert reactor.engine.execute("my.n") == 4.0 and reactor.engine.execute("my.twice") == 8.0
