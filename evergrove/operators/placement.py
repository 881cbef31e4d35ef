"""Where paths live: zones, a ring of nodes by consistent hashing, and when a zone
is worth splitting.

On Spark these are columns to partition writes by.  A ring is a sorted list of
points, ``points`` for every node, so its size is that of the cluster; a path's
place is found by bisection in one constant array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 32


def cuts_passed(at: Column, cuts: Sequence[int]) -> Column:
    """How many of the sorted ``cuts`` are not after ``at``; null for null."""
    if not cuts:
        return F.when(at.isNotNull(), F.lit(0))
    listed = F.array(*[F.lit(c) for c in cuts])
    passed, step = F.lit(0), 1 << (len(cuts).bit_length() - 1)
    while step:
        passed = F.element_at(F.transform(F.array(passed), _nearer(listed, len(cuts), at, step)), 1)
        step >>= 1
    return F.when(at.isNotNull(), passed)


def _nearer(listed: Column, count: int, at: Column, step: int):
    return lambda n: F.when((n + step <= count) & (F.get(listed, n + step - 1) <= at), n + step).otherwise(n)


def place_of(text: Column) -> Column:
    """A text's place on the ring: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def ring(nodes: Sequence[str], points: int = 64) -> list[tuple[int, str]]:
    """(place, node), sorted: every node stands at ``points`` places."""
    import hashlib

    return sorted((int(hashlib.md5(f"{node}#{k}".encode()).hexdigest()[: HASH_BITS // 4], 16), node) for node in nodes for k in range(points))


def zone_of(path: Column, depth: int = 2) -> Column:
    """A path's zone: its first names."""
    parts = F.split(path, "\\.")
    return F.array_join(F.slice(parts, F.lit(1), F.least(F.size(parts), F.lit(depth))), ".")


def placed(rows: DataFrame, nodes: Sequence[str], replicas: int = 2, path: str = "path", depth: int = 2, points: int = 64) -> DataFrame:
    """Adds ``zone``, ``authority`` (the next node on the ring) and ``replicas``
    (the distinct nodes after it)."""
    standing = ring(nodes, points)
    # the nodes that follow each point, once around
    owners = [list(dict.fromkeys(standing[(k + j) % len(standing)][1] for j in range(len(standing))))[: replicas + 1] for k in range(len(standing))]
    at = F.pmod(cuts_passed(place_of(F.col("zone")) - 1, [p for p, _ in standing]), F.lit(len(standing)))
    found = F.get(F.array(*[F.array(*map(F.lit, own)) for own in owners]), at)
    return rows.withColumn("zone", zone_of(F.col(path), depth)).withColumn("__owners", found).select("*", F.get("__owners", F.lit(0)).alias("authority"), F.slice("__owners", 2, replicas).alias("replicas")).drop("__owners")


def commit_groups(writes: DataFrame, nodes: Sequence[str], local: str, path: str = "path") -> DataFrame:
    """Staged writes by destination: (authority, local, zones, writes)."""
    by = placed(writes, nodes, path=path).groupBy("authority").agg(F.count_distinct("zone").alias("zones"), F.count("*").alias("writes"))
    return by.withColumn("local", F.col("authority") == local)


@dataclass(frozen=True)
class Thresholds:
    """What a zone may hold before it is split."""

    bytes: int = 100 * 1024 * 1024
    queries: float = 1_000.0
    writes: float = 500.0
    children: int = 1_000
    age_hours: float = 24.0


def split_advice(zones: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Adds ``split`` to (bytes, queries, writes, children, age_hours): 'spatial'
    for many children or high rates, 'temporal' for much old data, else null."""
    spatial = (F.col("children") > limits.children) | (F.col("queries") > limits.queries) | (F.col("writes") > limits.writes)
    temporal = (F.col("bytes") > limits.bytes) & (F.col("age_hours") >= limits.age_hours)
    return zones.withColumn("split", F.when(spatial, F.lit("spatial")).when(temporal, F.lit("temporal")).when(F.col("bytes") > limits.bytes, F.lit("spatial")))


def spatial_parts(rows: DataFrame, zone: str, bounds: Sequence[str] = ("m",), path: str = "path") -> DataFrame:
    """Rows below ``zone`` with ``part``, the zone they move to: by where the next
    name sorts between ``bounds``."""
    below = rows.where(F.col(path).startswith(zone + "."))
    name = F.lower(F.split_part(F.substring(F.col(path), F.lit(len(zone) + 2), F.length(path)), F.lit("."), F.lit(1)))
    part = F.lit(f"{zone}.a")
    for bound in sorted(bounds):
        part = F.when(name >= bound, F.lit(f"{zone}.{bound}")).otherwise(part)
    return below.withColumn("part", part)
