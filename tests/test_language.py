"""Programs, mounts and the log."""

import pytest

from evergrove.functions import model
from evergrove.functions.model import Unknown
from evergrove.operators import log as L
from evergrove.plans import syntax as S
from evergrove.plans.interpreter import Engine
from evergrove.plans.lexer import SyntaxProblem
from evergrove.plans.parser import parse, parse_expression


@pytest.fixture
def engine(spark):
    return Engine(spark, agent=1)


@pytest.mark.parametrize(
    ("source", "result"),
    [
        ("1 + 2 * 3 ^ 2", 19.0), ("2 ^ 3 ^ 2", 512.0), ("-2 + 5", 3.0), ("7 % 4", 3.0), ("not 0 and 1", True), ("t = 0\nfor x, i in [1, 2, 3]:\n    t = t + x * i\nt", 8.0), ("x = 3\nwhile x > 0:\n    x = x - 1\nx", 0.0),
        ("catch:\n    1 / 0\nelse unknown:\n    reason", "division by zero"), ("procedure f(n):\n    if n < 2:\n        return 1\n    return n * f(n - 1)\nf(5)", 120.0), ("consider 2:\n    case 1: \"a\"\n    case 2: \"b\"\n    default: \"c\"", "b"),
        ("[1, 2, 3, 4][item > 2]", [3.0, 4.0]), ("{a: 1, b: 2}[field > 1]", {"b": 2.0}), ("[10, 20][0]", 10.0), ('~"a{1 + 1}{{x}}"~', "a2{x}"), ("map([1, 2], procedure(x): x * 2)", [2.0, 4.0]), ("010 + 0", 10.0),
        ("if 0:\n    1\nelse if 1:\n    2\nelse:\n    3", 2.0), ('_"say "hi""_', 'say "hi"'), ("1_000 + 1", 1001.0), ("pass", None), ("for x in [1, 2, 3]:\n    if x = 2:\n        break\nx = 9\nx", 9.0), ("[3, 1, 2]..remove(0, 1)", [2.0]),
    ],
)
def test_programs(engine, source, result):
    assert engine.execute(source) == result


@pytest.mark.parametrize(
    ("source", "reason"),
    [("1 / 0", "division by zero"), ("foo(1)", "unknown function: foo"), ("for x in 5:\n    x", "cannot iterate over number"), ("[1][3]", "list index 3 out of bounds (length 1)"), ("5[1]", "cannot apply bracket filter to number"), ("[1, 1 / 0]", "division by zero"), ("{a: 1}.b", "field 'b' not found in record")],
)
def test_unknowns(engine, source, reason):
    assert engine.execute(source) == Unknown(reason)


def test_recursion_is_bounded(engine):
    assert "call depth exceeded" in engine.execute("procedure f(n): return f(n + 1)\nf(1)").reason


def test_syntax_errors(engine):
    assert engine.execute("a = (1").reason.startswith("parse error")
    with pytest.raises(SyntaxProblem):
        parse("if 1:\n   x = 1\n")


def test_precedence():
    tree = parse_expression("a or b and not c ?= d & e + 1")
    assert tree.op == "or" and tree.right.op == "and" and tree.right.right.op == "?=" and isinstance(tree.right.right.left, S.Unary)


def test_writes_are_read_back(engine):
    assert engine.execute('my.person = {name: "Alice", addr: {city: "Rome", zip: "00184"}, age: 30}\nmy.person.age') == 30.0
    assert engine.execute("my.person.addr") == {"city": "Rome", "zip": "00184"}
    assert engine.execute("my.person{name, phone}") == {"name": "Alice", "phone": Unknown("not_found")}
    assert engine.execute("my.person..count") == 3.0
    assert engine.log.children("world.agent.1.person") == ["addr", "age", "name"]
    assert engine.execute('k = "age"\nmy.person[k]') == 30.0


def test_dynamic_keys(engine):
    engine.execute('for n in ["a", "b"]:\n    my.t[n].v = n & "!"')
    assert engine.execute("my.t") == {"a": {"v": "a!"}, "b": {"v": "b!"}}


def test_unchanged_values_are_not_written(engine):
    engine.execute("my.x = 1")
    engine.execute("my.x = 1")
    assert engine.last_changes == []
    engine.execute("my.x = 2")
    assert engine.last_changes == ["world.agent.1.x"]
    assert engine.log.frame.count() == 2


def test_rollback(engine):
    assert engine.execute("my.y = 1\nfoo()") == Unknown("unknown function: foo")
    assert isinstance(engine.execute("my.y"), Unknown)
    engine.execute("my.y = 2\n1 / 0")
    assert engine.execute("my.y") == 2.0


def test_quiet_writes(engine):
    engine.execute("my.q = (quietly) {a: 1}\nmy.r = 2")
    assert engine.last_quiet == {"world.agent.1.q.a"}


def test_as_of(spark):
    from datetime import datetime

    log = L.InstanceLog(spark)
    log.append([("my.computer.b", 100.0)], at=datetime(2024, 1, 1, 10))
    log.append([("my.computer.b", 250.0)], at=datetime(2024, 1, 2, 10))
    engine = Engine(spark, log)
    assert engine.execute("my.computer.b") == 250.0
    assert engine.execute("my.computer.b[@2024-01-01]") == 100.0
    assert engine.execute("my.computer.b[@2024-01]") == 250.0
    assert "no value for" in engine.execute("my.computer.b[@2023]").reason


def test_purge_hides_and_audits(spark):
    from datetime import datetime

    log = L.InstanceLog(spark)
    log.append([("a.b", 1.0)], at=datetime(2024, 1, 1))
    log.append([("a.b", 2.0)], at=datetime(2024, 1, 3))
    assert log.purge("a", datetime(2024, 1, 2), datetime(2024, 1, 4)) == 1
    assert log.read("a.b") == 1.0
    assert log.children("_audit") != []


def test_extract(engine):
    engine.execute('my.e = {n: 1.5, t: "x", b: true, d: @2024-01, m: $2.50}')
    lines = sorted(r["line"].split(".", 4)[-1] for r in engine.log.extract("world.agent.1.e").collect())
    assert lines == ["b = true", "d = @2024-01", "m = ¤2.50 USD", "n = 1.5", 't = "x"']


def test_references(engine):
    engine.execute("my.a = {v: 7}\nmy.link = (link)my.a")
    assert engine.execute("my.link.v") == 7.0 or engine.execute("my.link") == {"v": 7.0}


def test_templates(engine):
    engine.execute('my.car: {wheels: 4, owner: "x", id: 9, plate: "p"}')
    engine.execute('my.car.owner.@heritability = "exclude"\nmy.car.id.@heritability = "reset"\nmy.car.id.@default = 0\nmy.car.plate.@heritability = "reset"')
    assert engine.execute("new(my.car)") == {"wheels": 4.0, "id": 0.0}
    made = engine.execute('new Van: (copy) {a: 1}, {a: 2, b: 3} {c: 4}')
    assert made == {"a": 1.0, "b": 3.0, "c": 4.0, "_type": "Van"}


def test_record_literals_with_modifiers(engine):
    engine.execute('my.car: {wheels: 4, id: (reset) 9, runs: (reset 0) 3, plate: (exclude) "p", maker: (link) "m", colour: (copy) "red"}')
    assert engine.execute("my.car{wheels, id, runs, plate}") == {"wheels": 4.0, "id": 9.0, "runs": 3.0, "plate": "p"}
    assert engine.execute("new(my.car)") == {"wheels": 4.0, "runs": 0.0, "maker": model.Ref("world.agent.1.car.maker"), "colour": "red"}
    assert engine.execute('new Van: {a: (exclude) 1, b: (reset 7) 2, c: 3}') == {"b": 7.0, "c": 3.0, "_type": "Van"}


def test_cascade(engine):
    engine.execute('world.shop.tax: (cascade) = 19\nworld.shop.food.tax: (cascade) = 7\nworld.shop.plain = 1')
    assert engine.execute("world.shop.food.bread.tax") == 7.0
    assert engine.execute("world.shop.books.novel.tax") == 19.0
    assert isinstance(engine.execute("world.shop.books.plain"), Unknown)


def test_permissions_are_asked(spark):
    engine = Engine(spark, may=lambda permission, path: permission == "read" or path.startswith("world.agent.0"))
    assert "permission denied" in engine.execute("world.x = 1").reason
    assert engine.execute("my.x = 1\nmy.x") == 1.0


@pytest.fixture
def mounted(spark, engine):
    people = [("alice", 25.0, True), ("bob", 40.0, False), ("carol", 35.0, True)]
    engine.mount("world.staff", spark.createDataFrame(people, "name string, age double, active boolean"), "name")
    return engine


@pytest.mark.parametrize(
    ("text", "names"),
    [("world.staff[age > 30]", {"bob", "carol"}), ("world.staff[active]", {"alice", "carol"}), ("world.staff[age > 30, active]", {"carol"}), ("world.staff[age > 38 or active and age < 30]", {"alice", "bob"}), ('world.staff["bob"]', {"bob"}), ("world.staff[carol]", {"carol"}), ("world.staff[not active]", {"bob"}), ('world.staff[key = "bob"]', {"bob"}), ("world.staff[salary > 1]", set()), ("world.staff[age / 0 > 1]", set())],
)
def test_collections(mounted, text, names):
    assert {r["name"] for r in mounted.query(text).collect()} == names


def test_collection_values(mounted):
    assert mounted.execute("world.staff[age > 30]..count") == 2.0
    mounted.execute("limit = 36")
    assert mounted.execute("limit = 36\nworld.staff[age > limit]..count") == 1.0
    assert mounted.query("world.staff{name, not x}").columns == ["name"]
    assert mounted.query("world.staff{a*}").columns == ["age", "active"]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.0, "a")], "k long, v double, w string").write.parquet(path)
    engine = Engine(spark)
    engine.mount("world.t", spark.read.parquet(path), "k")
    plan = engine.query('world.t[v > 1, w = "a"]{k}')._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,1.0)" in plan and "EqualTo(w,a)" in plan


def test_history_reads_only_what_is_projected(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.sql("select 1L user, timestamp_ntz'2024-01-01' ts, 1L seq, 2.0D v, 'x' unused").write.parquet(path)
    engine = Engine(spark)
    engine.mount("world.h", spark.read.parquet(path), "user", "ts", "seq")
    plan = engine.query("world.h[@2024]{user, v}")._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "LessThan(ts" in plan


def test_model_equality_of_kinds():
    assert model.compare("a", 1.0) is None and not model.equal(None, 0.0) and model.equal([1.0, "x"], [1.0, "x"])


def test_bridges_clock_and_time_functions(spark, engine):
    other = Engine(spark)
    other.execute("world.shared.x = 4")
    engine.bridge("mesh", other)
    assert engine.execute("my.mesh.world.shared.x") == 4.0
    assert engine.execute("world.clock.year") >= 2024.0 and 1 <= engine.execute("world.clock.weekday") <= 7
    assert engine.execute('text(add_time(@2024-01-31, 1, "month"))') == "2024-02-29"
    assert engine.execute('format_time(@2024-01-02, "%d.%m.")') == "02.01."
    assert engine.execute('convert("5", "number")') == 5.0


def test_single_calls(engine):
    from datetime import datetime

    assert engine.write("my.v", 1.0) and not engine.write("my.v", 1.0)
    assert engine.read("my.v") == 1.0 and engine.children("my") == ["v"]
    assert engine.purge("my.v", datetime(2000, 1, 1), datetime(2100, 1, 1)) == 1
    assert engine.read("my.v") == Unknown("not_found")


def test_paths():
    from evergrove.functions import paths

    assert paths.kind_of_path("my.mesh.world.x", ("mesh",)) == "bridge" and paths.kind_of_path("world.a") == "world"
    assert paths.resolve("my.a", 3) == "world.agent.3.a" and paths.resolve("my.computer.a", 3) == "my.computer.a"
    assert paths.rebased("a.b.c", "a.b", "x") == "x.c"
    with pytest.raises(paths.PathProblem):
        paths.parts_of("a..b")


def test_add_time_in_columns(spark):
    from evergrove.functions import columns as C
    from evergrove.plans.compiler import Row, compile_row

    cell = compile_row(parse_expression('text(add_time(parse_time("2024-01-31"), 1, "month")) & text(add_time(@2024-01-01 10:00, 90, "minutes"))'), Row())
    assert spark.range(1).select(cell.value.alias("t")).first()["t"] == "2024-02-292024-01-01 11:30"
    assert spark.range(1).select(compile_row(parse_expression('format_time(@2024-03-04, "dd.MM.")'), Row()).value.alias("t")).first()["t"] == "04.03."
    assert C.literal(1.0).constant == 1.0


def test_file_calls(engine, tmp_path):
    at = str(tmp_path / "r.xml")
    assert engine.execute(f'my.computer.files.export({{name: "a<b", n: 1}}, "{at}", "xml", {{root_element: "r"}})') is True
    assert engine.execute(f'my.computer.files.import("{at}", "xml")') == {"n": {"_text": "1"}, "name": {"_text": "a<b"}}
    assert engine.execute(f'my.computer.files.write("{tmp_path}/t.txt", "hi")\nmy.computer.files.read("{tmp_path}/t.txt")') == "hi"
    assert engine.execute(f'my.computer.files.info("{tmp_path}/t.txt").size') == 2.0
    assert "t.txt" in engine.execute(f'my.computer.files.list("{tmp_path}")')
    assert engine.execute(f'my.computer.files.export([{{k: 1, v: "x"}}, {{k: 2, v: "y"}}], "{tmp_path}/c", "csv")') is True
    assert engine.execute(f'my.computer.files.import("{tmp_path}/c", "csv", {{key: "k"}})[v = "y"]..count') == 1.0
    assert engine.execute(f'my.computer.files.delete("{tmp_path}/t.txt")\nmy.computer.files.exists("{tmp_path}/t.txt")') is False
    assert engine.execute(f'my.computer.files.export([1, 2], "{tmp_path}/j", "json")\nmy.computer.files.import("{tmp_path}/j", "json")') == [1.0, 2.0]
    assert isinstance(engine.execute('my.computer.files.read("/nowhere/x")'), Unknown)
    assert engine.execute('my.computer.files.import("x", "xlsx")') == Unknown("unsupported import format: xlsx")


def test_report_import(engine, tmp_path):
    (tmp_path / "r.txt").write_text("ID: 5\nSUM: $7.50")
    (tmp_path / "r.ari").write_text('section s:\n    field id: right 4 same: "ID:"\n    field sum: right 5 same: "SUM:"\n')
    assert engine.execute(f'my.computer.files.import_fixed_width("{tmp_path}/r.txt", "{tmp_path}/r.ari")') == {"s": {"id": 5.0, "sum": 7.5}}


def test_procedures_at_paths(engine):
    assert engine.execute("tools.twice: procedure(x): x * 2\ntools.twice(4)") == 8.0


def test_stored_permissions(spark):
    from evergrove.operators.visibility import may_by_log

    log = L.InstanceLog(spark)
    log.append([("world.team.@write", ["ann", "bob"]), ("world.team.private.@read", "(Nothing)"), ("world.team.v", 1.0), ("world.team.private.v", 2.0)])
    ann, eve = (Engine(spark, log, agent, may_by_log(log, name, agent)) for name, agent in (("ann", 1), ("eve", 2)))
    assert ann.execute("world.team.x = 3\nworld.team.x") == 3.0
    assert "permission denied" in eve.execute("world.team.x = 4").reason
    assert eve.execute("world.team.v") == 1.0
    assert isinstance(eve.execute("world.team.private.v"), Unknown)
    assert eve.execute("my.own = 1\nmy.own") == 1.0


def test_log_in_a_folder(spark, tmp_path):
    log = L.InstanceLog(spark, folder=str(tmp_path / "log"))
    for k in range(4):
        log.append([("a.b", float(k)), (f"a.c{k}", "x")])
    assert log.read("a.b") == 3.0 and log.frame.count() == 8
    L.compact(L.purge(log.frame, "a.c0", L.utc_now().replace(year=2000), L.utc_now().replace(year=2100)), str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == 7


def test_denied_reads(spark, engine):
    """Mounts, rows of mounts, children, records, as-of reads, cascades and extracts all ask."""
    engine.execute("world.r = {open: 1, shut: 2}\nworld.r.deep.shut = 3\nworld.tax: (cascade) = 5")
    closed = Engine(spark, engine.log, may=lambda permission, path: False)
    closed.mount("world.t", spark.range(3).withColumnRenamed("id", "k"), "k")
    for source in ("world.t", "world.t[1]", "world.t..count", "world.r", "world.r.open", "world.r[@2999]", "world.x.y.tax"):
        assert "permission denied" in closed.execute(source).reason, source
    with pytest.raises(ValueError):
        closed.query("world.t{k}")
    with pytest.raises(PermissionError):
        closed.extract("world.r")
    partly = Engine(spark, engine.log, may=lambda permission, path: not path.endswith(".shut"))
    assert partly.execute("world.r") == {"open": 1.0} and partly.children("world.r") == ["deep", "open"]
    assert partly.execute("world.r[@2999]") == {"open": 1.0}
    assert [r["line"] for r in partly.extract("world.r").collect()] == ["world.r.open = 1"]
    only_mount = Engine(spark, may=lambda permission, path: path != "world.t")
    only_mount.mount("world.t", spark.range(3).withColumnRenamed("id", "k"), "k")
    assert "permission denied" in only_mount.execute("world.t.1").reason


def test_permissions_by_log_are_asked_in_one_read(spark, monkeypatch):
    from evergrove.operators.visibility import may_by_log

    log = L.InstanceLog(spark)
    log.append([("world.a.@read", "(Anything)"), ("world.a.b.@read", "(Nothing)"), *((f"world.a.{n}.v", 1.0) for n in "bcd")])
    may, reads = may_by_log(log, "ann", 7), []
    monkeypatch.setattr(log, "read_many", lambda *a, f=log.read_many, **k: reads.append(1) or f(*a, **k))
    assert may.many("read", ["world.a.b.v", "world.a.c.v", "world.x", "my.computer.z"]) == {"world.a.c.v", "world.x"} and len(reads) == 1
    assert Engine(spark, log, 7, may).execute("world.a") == {"c": {"v": 1.0}, "d": {"v": 1.0}}


def test_views_hide_what_their_filter_matches(spark):
    log = L.InstanceLog(spark)
    log.append([("world.p.a", 1.0)], stamp={"zone": "eu"})
    log.append([("world.p.b", 2.0)], stamp={"zone": "us"})
    log.append([("world.p.b", 3.0)], stamp={"zone": "eu"})
    viewer = Engine(spark, log, view={"zone": "eu"})
    assert isinstance(viewer.execute("world.p.a"), Unknown) and viewer.children("world.p") == []
    log.append([("world.p.a", 4.0)], stamp={"zone": "us"})
    assert viewer.execute("world.p") == {"a": 4.0} and Engine(spark, log).execute("world.p") == {"a": 4.0, "b": 3.0}


def test_as_of_misses_name_their_cause(spark, engine):
    engine.execute("my.v = 1")
    assert engine.execute("my.v[@2001-02-03]") == Unknown("no value for my.v as of 2001-02-03: no instance found at timestamp 981244799999999 for path [world agent 1 v]")
    assert engine.execute("my.w[@2001]") == Unknown("no value for my.w as of 2001: path not found: [world agent 1 w]")


@pytest.mark.parametrize("text, value", [('"abcd" starts "ab"', True), ('"abcd" starts "b"', False), ("12 starts 1", True), ('not ("a" starts "b") and "a" starts ""', True)])
def test_starts(spark, engine, text, value):
    from evergrove.plans.compiler import Row, compile_row

    assert engine.execute(text) is value
    assert spark.range(1).select(compile_row(parse_expression(text), Row()).value.alias("v")).first()["v"] is value


def test_starts_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "abc"), (2, "xyz"), (3, None)], "k long, w string").write.parquet(path)
    engine = Engine(spark)
    engine.mount("world.t", spark.read.parquet(path), "k")
    found = engine.query('world.t[w starts "ab"]{k}')
    assert "StringStartsWith(w,ab)" in found._jdf.queryExecution().executedPlan().toString() and [r["k"] for r in found.collect()] == [1]


def test_sorting_by_a_field(spark, mounted):
    assert mounted.execute('map(sort([{n: 2, v: "b"}, {n: 1, v: "a"}, {v: "c"}], "n"), procedure(r): r.v)') == ["c", "a", "b"]
    assert [r["name"] for r in mounted.query('sort(world.staff, "age")').collect()] == ["alice", "carol", "bob"]
    assert mounted.execute('sort(world.staff, "x")') == Unknown("field 'x' not found in record")


def test_functions_in_row_context(spark, mounted):
    from evergrove.plans.compiler import Row, compile_row

    rows = mounted.mounts["world.staff"]
    value = lambda text: [r["v"] for r in rows.rows.orderBy("name").select(compile_row(parse_expression(text), Row(rows)).value.alias("v")).collect()]
    assert all(0 <= v < 25 and v == int(v) for v in value("random(25)")) and all(5 <= v < 9 for v in value("random(5, 9)")) and all(0 <= v < 1 for v in value("random()"))
    assert value('convert(age, "text")') == ["25", "40", "35"] and value('convert("7", "number") + age') == [32.0, 47.0, 42.0]
    assert value('asset(name, "text/plain").data') == ["alice", "bob", "carol"]
    assert all(v >= 2024 for v in value("world.clock.year")) and all(1 <= v <= 7 for v in value("world.clock.weekday"))


def test_newest_per_key_is_aggregated_by_hash(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = [(k % 3, f"2024-01-0{1 + k % 4}", k, float(k), str(k)) for k in range(40)] + [(7, None, 1, 1.0, "a"), (7, None, None, 2.0, "b"), (8, "2024-01-01", None, 3.0, "c"), (8, "2024-01-01", -5, 4.0, "d")]
    spark.createDataFrame(rows, "k long, day string, seq long, v double, w string").selectExpr("k", "to_timestamp_ntz(day) ts", "seq", "v", "w").write.parquet(path)
    log = spark.read.parquet(path)
    plan = L.current(log, "k").select("k", "v", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    by_struct = log.groupBy("k").agg(*[L.F.max_by(c, L.F.struct("ts", "seq")).alias(c) for c in ("ts", "seq", "v", "w")])
    assert sorted(map(tuple, L.current(log, "k").collect())) == sorted(map(tuple, by_struct.collect()))


def test_parse_errors_leave_the_engine_usable(engine):
    assert "parse error" in engine.execute("a = (").reason and engine.last_changes == []


def test_reports_have_a_limit(engine, tmp_path):
    (tmp_path / "r.txt").write_bytes(b"x" * (10 * 1024 * 1024 + 1))
    (tmp_path / "r.ari").write_text('section s:\n    field id: right 4 same: "ID:"\n')
    assert engine.execute(f'my.computer.files.import_fixed_width("{tmp_path}/r.txt", "{tmp_path}/r.ari")') == Unknown("#file_too_large: file size 10485761 exceeds maximum 10485760")


@pytest.mark.parametrize(
    ("body", "value"),
    [
        ("t = 0\nfor v in x:\n    t = t + v\nreturn t", 10.0), ("t = 0\nfor v, i in x:\n    t = t + v * i\nreturn t", 20.0),
        ("t = 0\nn = 0\nfor v in x:\n    if v > 2:\n        t = t + v\n        n = n + 1\n    else if v = 1:\n        t = t + 100\n    else:\n        pass\nreturn t * 10 + n", 1072.0),
        ("t = 0\nfor v in x:\n    for w in x:\n        if w <= v:\n            t = t + w\nreturn t", 20.0), ('t = ""\nfor v in x:\n    t = t & v & ","\nreturn t', "1,2,3,4,"),
        ("t = 1\nfor v in x:\n    t = t / (v - 3)\nreturn t", Unknown("division by zero")), ("for v in x:\n    pass\nreturn x..count", 4.0),
    ],
)
def test_loops_in_row_context_are_the_programs(spark, engine, body, value):
    from evergrove.plans.compiler import Row, compile_row

    source = "procedure f(x):\n" + "\n".join("    " + line for line in body.split("\n"))
    assert engine.execute(source + "\nf([1, 2, 3, 4])") == value
    procedure = parse(source).statements[0].value
    cell = compile_row(parse_expression("f([1, 2, 3, 4])"), Row(procedures={"f": procedure}))
    row = spark.range(1).select(cell.value.alias("v"), cell.why.alias("why")).first()
    assert (Unknown(row["why"]) if row["why"] is not None else row["v"]) == value


def test_loops_that_cannot_be_columns(spark):
    from evergrove.plans.compiler import CompileProblem, Row, compile_row

    for body in ("for v in x:\n        t = v\n    return t", 't = 0\n    for v in x:\n        t = "a"\n    return t', "for v in 5:\n        pass\n    return 1"):
        procedure = parse(f"procedure f(x):\n    {body}").statements[0].value
        with pytest.raises(CompileProblem):
            compile_row(parse_expression("f([1])"), Row(procedures={"f": procedure}))


def test_order_of_times_in_a_zone_that_skips_hours(spark):
    """02:30 comes before 03:00, also where the session's zone knows no 02:30."""
    rows = [(1, "2024-03-10 02:30:00.000001", 2, 1.0), (1, "2024-03-10 03:00:00", 1, 2.0), (2, "2024-11-03 01:30:00.5", 1, 3.0), (2, "2024-11-03 01:30:00.25", 2, 4.0), (3, "1901-01-01 23:59:59.999999", 5, 5.0), (3, None, 9, 6.0)]
    frame = spark.createDataFrame(rows, "k long, t string, seq long, v double").selectExpr("k", "cast(t as timestamp_ntz) ts", "seq", "v")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert {r["k"]: r["v"] for r in L.current(frame, "k").collect()} == {1: 2.0, 2: 3.0, 3: 5.0}
            ages = {(r["k"], r["v"]): r["age"] for r in L.history(frame, "k", ranges=4).collect()}
            assert ages[1, 2.0] == 1 and ages[2, 3.0] == 1 and ages[3, 6.0] == 2
            assert frame.select(L.micros(frame, "ts").alias("m")).collect()[0]["m"] == 1710037800000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
