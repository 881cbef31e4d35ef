"""Connected components of a distributed edge list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evergrove.llm.common import Scratch, checkpointed

TASK_EDGES = 200_000  # edges that one task joins before anything is shuffled
HEAVY = 5_000  # nodes with the most edges: the bound of the one broadcast
_LABELS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def connected_components(edges: DataFrame, into: Scratch | None = None, name: str = "components", rounds: int = 100) -> DataFrame:
    """(node, component): every node of ``edges`` (u, v) with the smallest node
    that it can reach.  Null ends and loops are ignored.

    Every task first joins the edges that it holds, which leaves at most one
    edge a node and settles small graphs at once.  What connects over several
    tasks is settled by alternating large and small stars: each round hooks every
    node's larger, then its smaller neighbours to the smallest one, and joins
    again, until all components are stars.  Edges never outnumber the input's and
    nothing is gathered on the driver.  The edges of a node with many of them are
    dealt to several tasks by salt.

    The result is a table of ``into``, or else a checkpoint.
    """
    with Scratch(edges.sparkSession) as own:
        given = own.table(edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "given")
        count = given.count()
        tasks = max(1, -(-count // TASK_EDGES))
        now = own.table(_joined(given, tasks), "0")
        for k in range(rounds):
            if _settled(now):
                break
            now = own.table(_joined(_small_star(_large_star(now, count), count), tasks), str(k + 1))
            own.drop(str(k))
        else:
            raise RuntimeError("components did not settle")
        stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        found = stars.unionAll(roots)
        return into.table(found, name) if into else checkpointed(found)


def _joined(edges: DataFrame, tasks: int) -> DataFrame:
    return edges.coalesce(tasks).mapInArrow(_join, "u long, v long")


def _join(batches):
    """The edges of one task to stars around their smallest nodes, by union and
    find; a full table is given out and begun anew."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def stars():
        found = [(node, root(node)) for node in list(parent)]
        found = [(node, top) for node, top in found if node != top]
        for at in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[at : at + 50_000])], schema=_LABELS)

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > 2 * TASK_EDGES:
            yield from stars()
            parent.clear()
    yield from stars()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at its larger end, or only smaller ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def _least(edges: DataFrame) -> DataFrame:
    """(w, m, n): every u with its smallest v and the number of its edges."""
    return edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """Every edge with its u's row of ``least``.  No more than HEAVY nodes can
    have over ``most`` edges; theirs are dealt out by salt."""
    most = max(2, -(-2 * count // HEAVY))
    salts = F.ceil(F.col("n") / most).cast("int")
    heavy = least.where(F.col("n") > most).select(F.col("w").alias("h"), salts.alias("salts"))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("salts"))).cast("int")
    dealt = edges.join(F.broadcast(heavy), F.col("u") == F.col("h"), "left").select("u", "v", salt.alias("salt"))
    copies = least.select("w", "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("s"))
    return dealt.join(copies, (F.col("u") == F.col("w")) & (F.col("salt") == F.col("s"))).select("u", "v", "m")


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Every node's larger neighbours, hooked to the smallest of it and all its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hooked = _with_least(both.where("v > u"), _least(both), count)
    return hooked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Every node and its smaller neighbours, hooked to the smallest of those."""
    least = _least(edges)
    moved = _with_least(edges, least, count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
