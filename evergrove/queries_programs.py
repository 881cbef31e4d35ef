"""Registered queries that run programs: statements, staged writes, rollback,
watchers, files and single calls, each with the SQL of its outcome.

Programs work on single values; their inputs here are the rows of ``nation`` and
``region``, tables of a fixed size.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrove.functions import model, paths
from evergrove.functions.display import display
from evergrove.operators import log as L
from evergrove.operators import placement
from evergrove.plans.interpreter import Engine
from evergrove.queries import query, table
from evergrove.sources import ari, files, xml
from evergrove.streaming import reactive
from evergrove.streaming.reactive import Reactor


def _nations(spark: SparkSession, sf_dir: str) -> list[dict]:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    return [{"key": float(r["n_nationkey"]), "name": r["n_name"], "region": float(r["n_regionkey"])} for r in rows]


def _outcome(spark: SparkSession, found: dict[str, object]) -> DataFrame:
    rows = [(name, None if value is None else value.reason if isinstance(value, model.Unknown) else model.to_text(value)) for name, value in found.items()]
    return spark.createDataFrame(rows, "name string, value string")


def _ran(engine: Engine, source: str, **bindings):
    from evergrove.plans.parser import parse

    return engine.run(parse(source).statements, bindings)


def _folder(spark: SparkSession) -> str:
    """A new folder beside the tables of the warehouse, which all executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/evergrove-files-{uuid.uuid4().hex}"


def _whole(sql: str) -> str:
    return f"CAST(CAST({sql} AS BIGINT) AS VARCHAR)"


# --- statements -------------------------------------------------------------------


@query(f"""SELECT 'for' AS name, {_whole('sum(n_nationkey)')} AS value FROM nation
UNION ALL SELECT 'if', {_whole('sum(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey WHEN n_nationkey > 20 THEN 100 ELSE 0 END)')} FROM nation
UNION ALL SELECT 'index', {_whole('sum(n_nationkey * (n_nationkey - 3))')} FROM nation
UNION ALL SELECT 'while', {_whole('(SELECT count(*) FROM nation WHERE n_regionkey > 1)')}
UNION ALL SELECT 'break', {_whole('min(n_nationkey)')} FROM nation WHERE n_regionkey = 3
UNION ALL SELECT 'consider', string_agg(CASE n_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END, '' ORDER BY n_nationkey) FROM nation
UNION ALL SELECT 'pass', NULL""")
def program_loops(spark, sf_dir):
    nations = _nations(spark, sf_dir)
    engine = Engine(spark, agent=3)
    run = lambda source: _ran(engine, source, nations=nations)
    return _outcome(spark, {
        "for": run("t = 0\nfor n in nations:\n    t = t + n.key\nt"),
        "if": run("t = 0\nfor n in nations:\n    if n.key % 2 = 0:\n        t = t + n.key\n    else if n.key > 20:\n        t = t + 100\n    else:\n        pass\nt"),
        "index": run("t = 0\nfor n, i in nations:\n    t = t + n.key * (i - 3)\nt"),
        "while": run("k = 0\nc = 0\nwhile k < nations..count:\n    if nations[k].region > 1:\n        c = c + 1\n    k = k + 1\nc"),
        "break": run("f = 0\nfor n in nations:\n    if n.region = 3:\n        f = n.key\n        break\nf"),
        "consider": run('t = ""\nfor n in nations:\n    consider n.region:\n        case 0: t = t & "a"\n        case 1: t = t & "b"\n        default: t = t & "c"\nt'),
        "pass": run("pass"),
    })


@query(f"""SELECT 'return' AS name, n_name AS value FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2)
UNION ALL SELECT 'recursion', {_whole('(SELECT count(*) FROM nation)')}
UNION ALL SELECT 'stored', {_whole('(SELECT 2 * count(*) FROM nation)')}
UNION ALL SELECT 'map', string_agg(upper(substr(n_name, 1, 2)), ' ' ORDER BY n_nationkey) FROM nation
UNION ALL SELECT 'sort', string_agg(n_name, ' ' ORDER BY n_regionkey, n_nationkey) FROM nation
UNION ALL SELECT 'catch', 'division by zero ' || count(*) FROM nation
UNION ALL SELECT 'catch_none', {_whole('(SELECT count(*) FROM nation)')}
UNION ALL SELECT 'output', min(n_name) FROM nation
UNION ALL SELECT 'unknown', 'nothing in ' || min(n_name) FROM nation
UNION ALL SELECT 'wrong_count', 'f expects 1 arguments, got 2'""")
def program_procedures(spark, sf_dir):
    nations = _nations(spark, sf_dir)
    engine = Engine(spark, agent=3)
    run = lambda source: _ran(engine, source, nations=nations)
    return _outcome(spark, {
        "return": run("procedure first(r):\n    for n in nations:\n        if n.region = r:\n            return n.name\n    return nothing\nfirst(2)"),
        "recursion": run("procedure f(k):\n    if k >= nations..count:\n        return 0\n    return 1 + f(k + 1)\nf(0)"),
        "stored": run("tools.twice: procedure(x): x * 2\ntools.twice(nations..count)"),
        "map": run('map(nations, procedure(n): upper(substring(n.name, 0, 2)))..combine(" ")'),
        "sort": run('map(sort(nations, "region"), procedure(n): n.name)..combine(" ")'),
        "catch": run('catch:\n    1 / 0\nelse unknown:\n    reason & " " & nations..count'),
        "catch_none": run("catch:\n    nations..count\nelse unknown:\n    0"),
        "output": run("output(sort(map(nations, procedure(n): n.name))[0])"),
        "unknown": run('unknown("nothing in " & sort(map(nations, procedure(n): n.name))[0])'),
        "wrong_count": run("procedure f(x): x\nf(1, 2)"),
    })


@query("""SELECT 'quote' AS name, '"' || min(n_name) || '"' AS value FROM nation UNION ALL SELECT 'tab', chr(9) || min(n_name) || chr(10) FROM nation
UNION ALL SELECT 'empty', '' UNION ALL SELECT 'extended', 'say "' || max(n_name) || '"' FROM nation
UNION ALL SELECT 'interpolated', string_agg(n_nationkey || ':' || n_name, ', ' ORDER BY n_nationkey) FROM nation
UNION ALL SELECT 'link', 'world.nation'
UNION ALL SELECT 'field', max(n_name) FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'missing', 'field ''nope'' not found in record'
UNION ALL SELECT 'records', CAST(count(*) = 25 AS VARCHAR) FROM nation
UNION ALL SELECT 'lists', 'true' UNION ALL SELECT 'uuid', '36' UNION ALL SELECT 'now', 'true' UNION ALL SELECT 'asset', 'text/plain'
UNION ALL SELECT 'random', 'true' UNION ALL SELECT 'pi', '3.14159' UNION ALL SELECT 'euler', '2.71828'""")
def program_literals(spark, sf_dir):
    nations = _nations(spark, sf_dir)
    names = sorted(n["name"] for n in nations)
    engine = Engine(spark, agent=3)
    run = lambda source: _ran(engine, source, nations=nations, least=names[0], most=names[-1], total=float(len(nations)))
    random = run("random(nations..count)")
    return _outcome(spark, {
        "quote": run("quote & least & quote"), "tab": run("tab & least & newline"), "empty": run("empty"), "extended": run('_"say ""_ & most & quote'),
        "interpolated": ", ".join(_ran(engine, '~"{n.key}:{n.name}"~', n=n) for n in nations),
        "link": run("(link)world.nation").path,
        "field": run("nations[3].name"), "missing": run("nations[3].nope"), "records": run("nations[0] = nations[0] and nations..count = 25 and nations[0] != nations[1]"),
        "lists": run("[1, total, least] = [1, total, least]"), "uuid": float(len(run("uuid()"))), "now": run("now() > @2024"), "asset": run('asset(least, "text/plain").mime_type'),
        "random": 0 <= random < 25 and random == int(random), "pi": run("text(pi)")[:7], "euler": run("text(euler)")[:7],
    })


@query("""SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS root, round(ln(1 + abs(s_acctbal)), 6) AS logarithm, round(exp(s_nationkey / 10.0), 6) AS power,
round(pi() * s_nationkey, 6) AS circle, s_name LIKE 'Supplier#0000000%' AS early, 'world.supplier.' || s_suppkey AS named FROM supplier""")
def math_functions(spark, sf_dir):
    engine = Engine(spark)
    engine.mount("world.supplier", table(spark, sf_dir, "supplier"), "s_suppkey")
    rows = engine.mounts["world.supplier"]
    from evergrove.plans.compiler import Row, compile_row
    from evergrove.plans.parser import parse_expression

    values = {"root": "sqrt(abs(s_acctbal))", "logarithm": "log(1 + abs(s_acctbal))", "power": "exp(s_nationkey / 10)", "circle": "pi * s_nationkey", "early": 's_name starts "Supplier#0000000"', "named": '~"world.supplier.{s_suppkey}"~'}
    cells = {name: compile_row(parse_expression(text), Row(rows)) for name, text in values.items()}
    found = rows.rows.select("s_suppkey", *[c.value.alias(name) for name, c in cells.items()])
    return found.withColumns({name: F.round(name, 6) for name in ("root", "logarithm", "power", "circle")})


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) LIKE '/de/%'")
def path_starts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    engine = Engine(spark)
    engine.mount("world.pages", pages, "page_id")
    return engine.query('world.pages[path starts "/de/"]{page_id, path}')


# --- paths, staged writes, rollback ----------------------------------------------------


@query("""SELECT 'world.agent.3.n.k' || n_nationkey || '.name' AS path, n_name AS value FROM nation
UNION ALL SELECT 'world.agent.3.n.k' || n_nationkey || '.region', CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT 'world.total', CAST(count(*) AS VARCHAR) FROM nation""")
def program_writes(spark, sf_dir):
    """Dynamic segments, records, scopes and relative paths; one commit."""
    engine = Engine(spark, agent=3)
    _ran(engine, 'for n in nations:\n    key = "k" & n.key\n    my.n[key] = {name: n.name, region: 0}\n    my.n[key].region = n.region\nworld.total = nations..count', nations=_nations(spark, sf_dir))
    return L.current(L.visible(engine.log.frame), "path").select("path", F.coalesce("v_text", F.col("v_num").cast("bigint").cast("string")).alias("value"))


@query(f"""SELECT 'staged' AS name, {_whole('sum(n_nationkey) + 1')} AS value FROM nation UNION ALL SELECT 'committed', {_whole('count(*)')} FROM nation
UNION ALL SELECT 'rolled_back', 'unknown function: nope' UNION ALL SELECT 'not_written', 'failed to read path [my lost]: not found'
UNION ALL SELECT 'kept', {_whole('max(n_nationkey)')} FROM nation UNION ALL SELECT 'unchanged', '0' UNION ALL SELECT 'quiet', '1'
UNION ALL SELECT 'too_many', 'commit buffer exceeded' UNION ALL SELECT 'scope', min(n_name) FROM nation""")
def program_commits(spark, sf_dir):
    nations = _nations(spark, sf_dir)
    engine = Engine(spark, agent=3)
    run = lambda source: _ran(engine, source, nations=nations, least=min(n["name"] for n in nations))
    found = {"staged": run("my.t = 1\nfor n in nations:\n    my.t = my.t + n.key\nmy.t")}
    run("for n in nations:\n    my.c[text(n.key)].name = n.name")
    found["committed"] = run("my.c..count")
    found["rolled_back"] = run("my.lost = 1\nnope()")
    found["not_written"] = run("my.lost")
    run("for n in nations:\n    my.kept = n.key\n1 / 0")
    found["kept"] = run("my.kept")
    run("my.same = least")
    run("my.same = least")
    found["unchanged"] = float(len(engine.last_changes))
    run("quietly:\n    my.q = least")
    found["quiet"] = float(len(engine.last_quiet))
    found["too_many"] = run("for a in 1..101:\n    for b in 1..100:\n        my.many[a & \"x\"][b & \"y\"] = 1")
    run("world.place.name = least")
    found["scope"] = run("world.place.\nname")
    return _outcome(spark, found)


@query("""SELECT 'nearest' AS name, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'above', '19' UNION ALL SELECT 'not_marked', 'failed to read path [world shop r3 plain]: not found'
UNION ALL SELECT 'embedded', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'made', n_name || ' true 0' FROM nation WHERE n_nationkey = 7
UNION ALL SELECT 'excluded', 'field ''secret'' not found in record' UNION ALL SELECT 'type', 'Shop' UNION ALL SELECT 'followed', n_name FROM nation WHERE n_nationkey = 7""")
def program_templates(spark, sf_dir):
    seven = _nations(spark, sf_dir)[7]
    engine = Engine(spark, agent=3)
    run = lambda source: _ran(engine, source, seven=seven)
    run("world.shop.tax: (cascade) = 19\nworld.shop.r7.tax: (cascade) = seven.region\nworld.shop.plain = 1")
    run('my.base: {title: seven.name, open: true, visits: 5, secret: "x"}')
    run('my.base.secret.@heritability = "exclude"\nmy.base.visits.@heritability = "reset"\nmy.base.visits.@default = 0')
    run("my.ref = (link)my.base")
    return _outcome(spark, {
        "nearest": run("world.shop.r7.deep.tax"), "above": run("world.shop.r3.tax"), "not_marked": run("world.shop.r3.plain"),
        "embedded": run("embed my.base\ntitle"), "made": run('m = new(my.base)\nm.title & " " & m.open & " " & m.visits'), "excluded": run("m = new(my.base)\nm.secret"),
        "type": run("new Shop: (copy) my.base {visits: 9}")["_type"], "followed": run("my.ref.title"),
    })


@query("""SELECT 'home' AS name, 'world.agent.3.v' AS value UNION ALL SELECT 'computer', 'my.computer.v' UNION ALL SELECT 'bridge', 'bridge' UNION ALL SELECT 'world', 'world'
UNION ALL SELECT 'rebased', 'world.b' || count(*) || '.c' FROM nation UNION ALL SELECT 'bad', 'true' UNION ALL SELECT 'write', 'true' UNION ALL SELECT 'again', 'false'
UNION ALL SELECT 'read', min(n_name) FROM nation UNION ALL SELECT 'children', string_agg(n_name, ' ' ORDER BY n_name) FROM nation
UNION ALL SELECT 'before', max(n_name) FROM nation UNION ALL SELECT 'purged', '1' UNION ALL SELECT 'after', 'not_found' UNION ALL SELECT 'bridged', min(n_name) FROM nation
UNION ALL SELECT 'denied', 'failed to read path world.agent.3.v: permission denied' UNION ALL SELECT 'denied_children', '' UNION ALL SELECT 'hidden', 'failed to read path [my v]: not found'""")
def single_calls(spark, sf_dir):
    """The agent's own calls: read, write, list, as-of, purge, bridge; and refusals."""
    names = sorted(n["name"] for n in _nations(spark, sf_dir))
    log = L.InstanceLog(spark)
    engine, found = Engine(spark, log, agent=3), {}
    found["home"], found["computer"] = engine.resolve("my.v"), engine.resolve("my.computer.v")
    found["bridge"], found["world"] = paths.kind_of_path("my.mesh.world.x", ("mesh",)), paths.kind_of_path("world.x", ())
    found["rebased"] = paths.rebased("a.b.c", "a.b", f"world.b{len(names)}")
    try:
        found["bad"] = bool(paths.parts_of("a..b")) and False
    except paths.PathProblem:
        found["bad"] = True
    log.append([("world.agent.3.v", names[-1])], author=3, at=datetime(2024, 1, 1))
    found["write"], found["again"], found["read"] = engine.write("my.v", names[0]), engine.write("my.v", names[0]), engine.read("my.v")
    _ran(engine, "for n in names:\n    my.list[n] = 1", names=names)
    found["children"] = " ".join(engine.children("my.list"))
    found["before"] = engine.read("my.v", model.parse_time("2024-06"))
    other = Engine(spark, agent=4)
    other.bridge("mesh", Engine(spark, log, agent=3))
    found["bridged"] = other.execute("my.mesh.world.agent.3.v")
    refused = Engine(spark, log, agent=3, may=lambda permission, path: False)
    found["denied"], found["denied_children"] = refused.execute("my.v"), " ".join(refused.children("my.list"))
    found["hidden"] = Engine(spark, log, agent=3, view={"@author": ["3"]}).execute("my.v")
    found["purged"] = float(engine.purge("my.v", datetime(2025, 1, 1), datetime(2100, 1, 1)))
    engine.purge("my.v", datetime(2000, 1, 1), datetime(2100, 1, 1))
    found["after"] = engine.read("my.v")
    return _outcome(spark, found)


@query("""SELECT doc_id, lang FROM documents WHERE NOT (lang IN ('de', 'fr') AND source = 'src0') AND lang <> 'es'""")
def filtered_read(spark, sf_dir):
    """A viewer's filter and a predicate in one read of a mounted collection."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.create_map(F.lit("lang"), "lang", F.lit("source"), F.coalesce("source", F.lit(""))).alias("stamp"))
    engine = Engine(spark, view={"lang": ["de", "fr"], "rule": "source ?= 'src0'"})
    engine.mount("world.documents", docs, "doc_id")
    return engine.query('world.documents[lang != "es"]{doc_id, lang}')


# --- watchers ---------------------------------------------------------------------------


@query(f"""SELECT 'ticks' AS name, '2' AS value UNION ALL SELECT 'copied', n_name FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation)
UNION ALL SELECT 'cascaded', n_name || '!' FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation)
UNION ALL SELECT 'isolated', '7' UNION ALL SELECT 'appended', {_whole('sum(n_nationkey)')} FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'quiet', '0' UNION ALL SELECT 'problem', 'bad: division by zero' UNION ALL SELECT 'not_written', 'failed to read path [my bad]: not found'""")
def watcher_ticks(spark, sf_dir):
    """Bodies run on the state before the tick, cascades take a tick per link,
    append watchers get their items, an unknown rolls the tick back."""
    nations = _nations(spark, sf_dir)
    engine = Engine(spark, agent=3)
    reactor, found = Reactor(engine), {}
    reactor.write("my.out = 7")
    reactor.write("my.copy: watch (my.source):\n    my.middle = my.source")
    reactor.write("my.see: watch (my.source):\n    my.seen = my.out")
    reactor.write("my.touch: watch (my.source):\n    my.out = 1")
    reactor.write('my.then: watch (my.middle):\n    my.sink = my.middle & "!"')
    reactor.write("my.sum: watch append(my.queue[region = 1]) as items:\n    t = 0\n    for n in items:\n        t = t + n.key\n    my.total = t")
    reactor.settle()
    _ran(engine, "for n in nations:\n    my.source = n.name", nations=nations)
    reactor.record_changes()
    found["ticks"] = float(reactor.settle())
    found["copied"], found["cascaded"], found["isolated"] = (engine.execute(p) for p in ("my.middle", "my.sink", "my.seen"))
    for n in nations:
        reactor.append("my.queue", n)
    reactor.settle()
    found["appended"] = engine.execute("my.total")
    reactor.write("quietly:\n    my.source = 0")
    found["quiet"] = float(reactor.settle())
    reactor.write("my.wrong: watch (my.trigger):\n    my.bad = 1\n    1 / 0")
    reactor.watchers[-1].name = "bad"
    reactor.write("my.trigger = 1")
    reactor.tick()
    found["problem"], found["not_written"] = reactor.problems[-1], engine.execute("my.bad")
    return _outcome(spark, found)


def _event_stream(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]").select(  # a pattern, since the table may be one file
        F.concat(F.lit("world.users."), F.col("user_id").cast("string"), F.lit("."), "event_type").alias("path"), "user_id", "ts", "event_id", "event_type", "value"
    )


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type <> 'view' GROUP BY user_id")
def stream_commits(spark, sf_dir):
    """A stream of changes in ticks, committed to files, read as current values."""
    at = _folder(spark)
    reactive.tick_stream(_event_stream(spark, sf_dir).where("event_type <> 'view'"), at, f"{at}/checkpoint", available_now=True).awaitTermination()
    changes = spark.read.parquet(f"{at}/changes")
    return L.current(changes, "user_id", "ts", "event_id").select("user_id", "value")


@query("""SELECT DISTINCT n AS name FROM events, (VALUES ('all', -1, ''), ('seven', 7, ''), ('nine_view', 9, 'view'), ('nobody', -5, '')) w(n, u, t) WHERE (u = -1 OR user_id = u) AND (t = '' OR event_type = t)""")
def stream_triggers(spark, sf_dir):
    """The watchers that a stream of changes triggers."""
    at = _folder(spark)
    registry = spark.createDataFrame([("all", ["world.users"], True), ("seven", ["world.users.7"], True), ("nine_view", ["world.users.9.view"], True), ("nobody", ["world.users.-5"], True), ("off", ["world"], False)], "name string, watching array<string>, enabled boolean")
    reactive.tick_stream(_event_stream(spark, sf_dir), at, f"{at}/checkpoint", registry, available_now=True).awaitTermination()
    return spark.read.parquet(f"{at}/triggered").select("name").distinct()


@query("""SELECT 'total' AS name, CAST(count(*) AS VARCHAR) AS value FROM nation UNION ALL SELECT 'last', n_name || '!' FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation)""")
def stream_reactions(spark, sf_dir):
    """Watcher programs fed by a stream."""
    at = _folder(spark)
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("world.in.n"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("value"))
    rows.coalesce(1).write.parquet(f"{at}/in")
    reactor = Reactor(Engine(spark, agent=3))
    reactor.write('watch seen (world.in): my.total = world.in..count')
    reactor.write('watch last (world.in.n24): my.last = world.in.n24 & "!"')
    reactive.react_stream(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), reactor, f"{at}/checkpoint", available_now=True).awaitTermination()
    files.delete(spark, at)
    return _outcome(spark, {"total": reactor.engine.execute("my.total"), "last": reactor.engine.execute("my.last")})


# --- sources ---------------------------------------------------------------------------


def _written(form: str):
    def run(spark, sf_dir):
        """A collection written and imported by the file calls of the language."""
        at = f"{_folder(spark)}/{form}"
        engine = Engine(spark)
        engine.mount("world.nation", table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name"), "n_nationkey")
        options = {"schema": "n_nationkey string, n_name string", "key": "n_nationkey"} | ({"lines": True} if form == "json" else {})
        done = _ran(engine, f'my.computer.files.export(world.nation, "{at}", "{form}", options)', options=options)
        assert done is True, done
        return _ran(engine, f'my.computer.files.import("{at}", "{form}", options)', options=options).rows.select("n_nationkey", "n_name")

    return run


for _form in ("json", "csv", "tsv"):
    _run = _written(_form)
    _run.__name__ = f"files_{_form}"
    query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")(_run)


@query("""SELECT 'read' AS name, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS value FROM nation UNION ALL SELECT 'exists', 'true' UNION ALL SELECT 'size', CAST(sum(strlen(n_name) + 1) - 1 AS VARCHAR) FROM nation
UNION ALL SELECT 'list', 'n.txt' UNION ALL SELECT 'deleted', 'true' UNION ALL SELECT 'gone', 'false' UNION ALL SELECT 'document', max(n_name) FROM nation
UNION ALL SELECT 'toml', min(n_name) FROM nation UNION ALL SELECT 'xml', min(n_name) FROM nation UNION ALL SELECT 'form', 'unsupported import format: xlsx'""")
def file_calls(spark, sf_dir):
    names = [n["name"] for n in _nations(spark, sf_dir)]
    at, engine = _folder(spark), Engine(spark)
    run = lambda source, **more: _ran(engine, source, at=at, text="\n".join(names), least=min(names), most=max(names), **more)
    run('my.computer.files.write(at & "/d/n.txt", text)')
    run('my.computer.files.write(at & "/t.toml", "[top]" & newline & "name = " & quote & least & quote)')
    run('my.computer.files.export({name: most}, at & "/j.json", "json")')
    run('my.computer.files.export({name: least}, at & "/x.xml", "xml", {root_element: "nation"})')
    found = _outcome(spark, {
        "read": run('my.computer.files.read(at & "/d/n.txt")'), "exists": run('my.computer.files.exists(at & "/d/n.txt")'), "size": run('my.computer.files.info(at & "/d/n.txt").size'),
        "list": run('my.computer.files.list(at & "/d")..combine(",")'), "deleted": run('my.computer.files.delete(at & "/d/n.txt")'), "gone": run('my.computer.files.exists(at & "/d/n.txt")'),
        "document": run('my.computer.files.import(at & "/j.json", "json").name'), "toml": run('my.computer.files.import(at & "/t.toml", "toml").top.name'),
        "xml": run('my.computer.files.import(at & "/x.xml", "xml").name._text'), "form": run('my.computer.files.import(at, "xlsx")'),
    })
    files.delete(spark, at)
    return found


@query("SELECT n_nationkey, n_name FROM nation")
def xml_rows(spark, sf_dir):
    """Rows written as XML and read by row tag."""
    at = f"{_folder(spark)}/x"
    xml.write_xml(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), at, "nation", "nations")
    return xml.read_xml(spark, at, "nation", "n_nationkey int, n_name string")


@query("""SELECT 'world.part.' || p_brand || '.p' || p_partkey AS path, p_size::DOUBLE AS v_num FROM part WHERE p_partkey % 3 <> 0""")
def compact_log(spark, sf_dir):
    """A log with purged instances, compacted into files and read again."""
    rows = table(spark, sf_dir, "part").withColumns({"ts": F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, p_partkey % 3)")})
    log = L.instances_of(rows, F.concat(F.lit("world.part."), "p_brand", F.lit(".p"), F.col("p_partkey").cast("string")), "ts", "p_partkey", "p_size")
    at = f"{_folder(spark)}/log"
    L.compact(L.purge(log, "world.part", datetime(2024, 1, 1), datetime(2024, 1, 1)), at)
    return L.current(spark.read.schema(L.SCHEMA).parquet(at), "path").select("path", "v_num")


@query("""SELECT 'world.e.k' || n_nationkey || '.text = "' || n_name || '"' AS line FROM nation UNION ALL SELECT 'world.e.k' || n_nationkey || '.number = ' || n_nationkey || '.5' FROM nation
UNION ALL SELECT 'world.e.k' || n_nationkey || '.boolean = ' || CAST(n_nationkey > 9 AS VARCHAR) FROM nation UNION ALL SELECT 'world.e.k' || n_nationkey || '.time = @2024-01' FROM nation
UNION ALL SELECT 'world.e.k' || n_nationkey || '.money = ¤' || n_nationkey || '.25 USD' FROM nation UNION ALL SELECT 'world.e.k' || n_nationkey || '.link = (link)world.n' || n_nationkey FROM nation
UNION ALL SELECT 'world.e.k' || n_nationkey || '.list = [1,"x"]' FROM nation UNION ALL SELECT 'world.e.k' || n_nationkey || '.nothing = nothing' FROM nation""")
def extract_every_kind(spark, sf_dir):
    engine = Engine(spark)
    writes = []
    for n in _nations(spark, sf_dir):
        at = f"world.e.k{int(n['key'])}"
        values = {"text": n["name"], "number": n["key"] + 0.5, "boolean": n["key"] > 9, "time": model.parse_time("2024-01"), "money": model.Money(n["key"] + 0.25, "USD"), "link": model.Ref(f"world.n{int(n['key'])}"), "list": [1.0, "x"], "nothing": None}
        writes += [(f"{at}.{name}", value) for name, value in values.items()]
    engine.log.append(writes)
    return engine.extract("world.e")


_TYPES = '''type owed: "[0-9.]+-?"
    negate "-"
    as decimal
section head starts("BEGIN") ends("END"):
    field code: right 6 same: "CODE:" /X[0-9]+/
    field below: down 1 right 5 same: "CODE:" integer
    field total: right 7 same: "TOTAL:" owed
section rows:
    field name: right 6 same: "NAME:"
    field size: right 6 same: "SIZE:" integer
    break'''


@query("""SELECT o_orderkey AS id, '{"head":{"below":' || o_custkey || ',"code":"X' || o_orderkey || '","total":' || CASE WHEN o_orderkey % 2 = 1 THEN -o_custkey ELSE o_custkey END || '},"rows":[{"name":"a","size":1},{"name":"b","size":' || o_custkey || '}]}' AS record FROM orders""")
def ari_types(spark, sf_dir):
    """Custom types, moves over lines, and records of several lines."""
    key, number = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    sign = F.when(F.col("o_orderkey") % 2 == 1, F.lit("-")).otherwise(F.lit(""))
    lines = [F.lit("BEGIN"), F.concat(F.lit("CODE: X"), key), F.concat(F.lit("     "), number), F.concat(F.lit("TOTAL: "), number, F.lit(".00"), sign), F.lit("END")]
    lines += [F.lit("NAME: a"), F.lit("SIZE: 1"), F.lit("NAME: b"), F.concat(F.lit("SIZE: "), number)]
    reports = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", *lines).alias("report"))
    return ari.extract_reports(reports, _TYPES, "o_orderkey", "report")


# --- answers, tokens, status ------------------------------------------------------------


@query("""SELECT 'world.agent.3.x' AS path, '' AS value WHERE false UNION ALL
SELECT 'my.computer.network.web.requests.' || n_nationkey || '.response.' || f, CASE f WHEN 'status_code' THEN CASE WHEN n_nationkey % 3 = 0 THEN '404' WHEN n_nationkey % 3 = 1 THEN '200' ELSE '302' END
ELSE CASE WHEN n_nationkey % 3 = 0 THEN 'Not Found' WHEN n_nationkey % 3 = 1 THEN '{"page":' || n_nationkey || '}' ELSE 'Found' END END
FROM nation, (VALUES ('status_code'), ('body')) t(f)""")
def web_answers(spark, sf_dir):
    """A request for every nation, answered by one program; responses are staged writes."""
    engine = Engine(spark, agent=3)
    ids = [n["key"] for n in _nations(spark, sf_dir)]
    done = _ran(engine, """for id in ids:
    req = {id: text(id)}
    if id % 3 = 0:
        my.computer.network.web.not_found(req)
    else if id % 3 = 1:
        my.computer.network.web.ok_json(req, {page: id})
    else:
        my.computer.network.web.redirect(req, "/other")""", ids=ids)
    assert not isinstance(done, model.Unknown), done
    rows = L.current(L.visible(engine.log.frame), "path").where(~F.col("path").contains(".headers"))
    return rows.select("path", F.coalesce("v_text", F.col("v_num").cast("bigint").cast("string")).alias("value"))


@query("""SELECT 'status' AS name, 'agent: 3' || chr(10) || 'instances: ' || count(*) || chr(10) || 'visible: ' || count(*) || chr(10) || 'paths: ' || count(*) || chr(10) || 'mounts: 0' || chr(10) || 'watches: 0' AS value FROM nation
UNION ALL SELECT 'table', 'key  name' || chr(10) || '---  ' || repeat('-', max(length(n_name))::INT) || chr(10) || string_agg(rpad(CAST(n_nationkey AS VARCHAR), 5, ' ') || n_name, chr(10) ORDER BY n_nationkey) FROM nation
UNION ALL SELECT 'list', '[' || string_agg(CAST(n_nationkey AS VARCHAR), ', ' ORDER BY n_nationkey) || ']' FROM nation UNION ALL SELECT 'unknown', 'unknown(division by zero)'
UNION ALL SELECT 'money', '2.50 USD' UNION ALL SELECT 'nothing', '' UNION ALL SELECT 'token', '64' UNION ALL SELECT 'json', '{"n":' || count(*) || '}' FROM nation""")
def shown_values(spark, sf_dir):
    nations = _nations(spark, sf_dir)
    engine = Engine(spark, agent=3)
    run = lambda source: _ran(engine, source, nations=nations)
    run("for n in nations:\n    my.n[text(n.key)] = n.name")
    status = engine.status()
    status.pop("last")
    return _outcome(spark, {
        "status": display(status), "table": display([{"key": n["key"], "name": n["name"]} for n in nations]), "list": display([n["key"] for n in nations]),
        "unknown": display(run("1 / 0")), "money": display(run("$2.50")), "nothing": display(None), "token": float(len(run("my.computer.crypto.generate_token()"))),
        "json": run("my.computer.network.web.to_json({n: nations..count})"),
    })


# --- placement ---------------------------------------------------------------------------

_NODES = ("north", "south", "west")
_PLACED = """WITH points AS (SELECT ('0x' || substr(md5(n || '#' || k), 1, 8))::BIGINT AS place, n FROM (VALUES ('north'), ('south'), ('west')) t(n), range(64) r(k)),
zones AS (SELECT DISTINCT 'world.b' || p_brand AS zone FROM part),
owners AS (SELECT zone, coalesce((SELECT arg_min(n, (place, n)) FROM points WHERE place >= ('0x' || substr(md5(zone), 1, 8))::BIGINT), (SELECT arg_min(n, (place, n)) FROM points)) AS authority FROM zones)"""


def _brand_paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("world.b"), F.replace("p_brand", F.lit("."), F.lit("_")), F.lit(".p"), F.col("p_partkey").cast("string")).alias("path"), "p_partkey")


@query(_PLACED + " SELECT p_partkey, zone, authority FROM part JOIN owners ON zone = 'world.b' || p_brand")
def ring_placement(spark, sf_dir):
    return placement.placed(_brand_paths(spark, sf_dir), _NODES).select("p_partkey", "zone", "authority")


@query(_PLACED + " SELECT authority, authority = 'north' AS local, count(DISTINCT zone) AS zones, count(*) AS writes FROM part JOIN owners ON zone = 'world.b' || p_brand GROUP BY authority")
def commit_by_zone(spark, sf_dir):
    return placement.commit_groups(_brand_paths(spark, sf_dir), _NODES, "north").select("authority", "local", "zones", "writes")


@query("""SELECT o_custkey AS zone, CASE WHEN count(*) > 12 THEN 'spatial' WHEN sum(o_totalprice) > 1500000 AND max(o_orderkey) % 48 >= 24 THEN 'temporal' WHEN sum(o_totalprice) > 1500000 THEN 'spatial' END AS split FROM orders GROUP BY o_custkey""")
def zone_splits(spark, sf_dir):
    stats = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("zone")).agg(F.sum("o_totalprice").alias("bytes"), F.count("*").alias("children"), F.lit(0.0).alias("queries"), F.lit(0.0).alias("writes"), (F.max("o_orderkey") % 48).alias("age_hours"))
    return placement.split_advice(stats, placement.Thresholds(bytes=1_500_000, children=12)).select("zone", "split")


@query("SELECT c_custkey, CASE WHEN lower(left(c_mktsegment, 1)) >= 'm' THEN 'world.s.m' ELSE 'world.s.a' END AS part FROM customer WHERE c_mktsegment IS NOT NULL")
def zone_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("world.s."), "c_mktsegment", F.lit(".c")).alias("path"))
    return placement.spatial_parts(rows, "world.s").select("c_custkey", "part")


# --- loops in row context -------------------------------------------------------------------


@query("""SELECT p_partkey, coalesce(list_sum(list_transform(list_filter(string_split(p_type, ' '), lambda w: strlen(w) > 5), lambda w: strlen(w)))::DOUBLE, 0) AS long_letters,
list_sum(list_transform(string_split(p_name, ' '), lambda w, i: strlen(w) * (i - 1)))::DOUBLE AS weighted FROM part""")
def loops_in_rows(spark, sf_dir):
    """Procedures with loops over a row's list, as one expression each."""
    from evergrove.plans.compiler import Row, compile_row
    from evergrove.plans.parser import parse, parse_expression

    parts = Engine(spark)
    parts.mount("world.part", table(spark, sf_dir, "part"), "p_partkey")
    source = """procedure long_letters(words):
    t = 0
    for w in words:
        if len(w) > 5:
            t = t + len(w)
    return t
procedure weighted(words):
    t = 0
    for w, i in words:
        t = t + len(w) * i
    return t"""
    procedures = {s.target.dotted(): s.value for s in parse(source).statements}
    rows = parts.mounts["world.part"]
    row = Row(rows, procedures=procedures)
    cells = {"long_letters": compile_row(parse_expression('long_letters(split(p_type, " "))'), row), "weighted": compile_row(parse_expression('weighted(split(p_name, " "))'), row)}
    return rows.rows.select("p_partkey", *[c.value.alias(name) for name, c in cells.items()])
