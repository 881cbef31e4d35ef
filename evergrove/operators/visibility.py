"""Who sees what: permissions on paths, stamps on rows, filters that hide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERMISSIONS = ("read", "write", "expand", "grant", "purge")


def default_permission(path: Column, permission: str, agent: int) -> Column:
    """Everything in the agent's own home, reading anywhere in the world."""
    home = f"world.agent.{agent}"
    own = (path == home) | path.startswith(home + ".")
    world = (path == "world") | path.startswith("world.")
    return own | (world if permission == "read" else F.lit(False))


def condition_holds(condition: Column, identity: str) -> Column:
    """(Anything), (Nothing), true, false, one identity or a JSON list of them."""
    listed = F.from_json(condition, "array<string>")
    return (
        F.when(condition.isin("(Anything)", "true"), F.lit(True))
        .when(condition.isNull() | condition.isin("(Nothing)", "false"), F.lit(False))
        .when(condition.startswith("["), F.coalesce(F.array_contains(listed, identity), F.lit(False)))
        .otherwise(condition == identity)
    )


def effective_permission(paths: DataFrame, grants: DataFrame, permission: str, identity: str, agent: int, path: str = "path") -> DataFrame:
    """Adds ``allowed`` and ``granted_at``, the nearest ancestor (the path itself
    included) with a grant; without any, the default decides.

    ``grants`` (owner, permission, condition).  Distinct paths are exploded into
    their ancestors and joined on equality, so the work is linear in the paths.
    """
    parts = F.split(F.col(path), "\\.")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("ancestor")))
    wide = paths.select(path).distinct().select(F.col(path).alias("p"), F.explode(steps).alias("s")).select("p", "s.depth", "s.ancestor")
    own = grants.where(F.col("permission") == permission).select("owner", "condition")
    nearest = wide.join(own, F.col("ancestor") == F.col("owner")).groupBy("p").agg(F.max_by("condition", "depth").alias("__condition"), F.max_by("owner", "depth").alias("granted_at"))
    joined = paths.join(nearest, F.col(path) == F.col("p"), "left")
    allowed = F.when(F.col("granted_at").isNotNull(), condition_holds(F.col("__condition"), identity)).otherwise(default_permission(F.col(path), permission, agent))
    return joined.withColumn("allowed", allowed).drop("p", "__condition")


def merged_stamps(*stamps: Column) -> Column:
    """Maps merged in order: the later, deeper one wins."""
    entries = F.concat(*[F.map_entries(s) for s in stamps])
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(kept)


def embedded_stamp(host: Column, embeds: Sequence[Column], protected: Sequence[str] = ()) -> Column:
    """The host's own entries win; of the embedded ones a later beats an earlier;
    protected names are taken from the host only."""
    if not embeds:
        return host
    below = merged_stamps(*embeds)
    free = F.map_filter(below, lambda k, _: ~F.coalesce(F.map_contains_key(host, k), F.lit(False)) & ~k.isin(list(protected)))
    return F.map_concat(host, free)


def with_stamp(rows: DataFrame, stamp: str, key: str, value: object) -> DataFrame:
    """Rows whose stamp has that value."""
    return rows.where(F.col(stamp)[key] == value)


def matches(stamp: Column, expressions: Mapping[str, object]) -> Column:
    """Whether all expressions match: a list means one of them, anything else
    equality; an attribute that the stamp lacks does not match."""
    test = F.lit(True)
    for attribute, wanted in expressions.items():
        value = F.try_element_at(stamp, F.lit(attribute))
        one = value.isin([str(w) for w in wanted]) if isinstance(wanted, (list, tuple, set)) else value == str(wanted)
        test = test & F.coalesce(one, F.lit(False))
    return test


def hide(rows: DataFrame, stamp: Column, expressions: Mapping[str, object]) -> DataFrame:
    """The rows that a filter leaves visible.  A filter without expressions hides
    nothing."""
    return rows.where(~matches(stamp, expressions)) if expressions else rows


def parse_filter(record: Mapping[str, object]) -> dict[str, object]:
    """A filter record: values are lists, plain values or ``attr ?= 'x'`` texts."""
    import re

    out: dict[str, object] = {}
    for name, value in record.items():
        match = re.fullmatch(r"\s*([\w@.]+)\s*\?=\s*['\"](.*)['\"]\s*", value) if isinstance(value, str) else None
        out[match[1] if match else name] = match[2] if match else value
    return out


def may_by_log(log, identity: str, agent: int):
    """An engine's permission test from the ``@read``, ``@write``, ... fields that
    are stored in its log: the nearest ancestor's condition, else the default."""

    def holds(condition) -> bool:
        if isinstance(condition, bool):
            return condition
        if isinstance(condition, list):
            return identity in condition
        return condition == "(Anything)" or condition == identity

    home = f"world.agent.{agent}"

    def many(permission: str, paths: Sequence[str]) -> set[str]:
        """Those of ``paths`` that are allowed: one read of all their ancestors."""
        above = {path: _upwards(path) for path in paths}
        stored = log.read_many(list({f"{owner}.@{permission}" for owners in above.values() for owner in owners}))
        allowed = set()
        for path, owners in above.items():
            nearest = next((f"{o}.@{permission}" for o in owners if f"{o}.@{permission}" in stored), None)
            default = path == home or path.startswith(home + ".") or path.split(".")[0] == "world" and permission == "read"
            if holds(stored[nearest]) if nearest else default:
                allowed.add(path)
        return allowed

    def may(permission: str, path: str) -> bool:
        return path in many(permission, [path])

    may.many = many
    return may


def _upwards(path: str) -> list[str]:
    """The path and its ancestors, nearest first."""
    parts = path.split(".")
    return [".".join(parts[:n]) for n in range(len(parts), 0, -1)]
