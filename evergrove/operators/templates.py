"""Templates, inheritance rules and cascading defaults."""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evergrove.functions import model


def heritage(target: dict, source: Mapping, rules: Mapping, path: str | None = None) -> dict:
    """``target`` with the fields of one more source.

    copy and link: the first source that has a field wins; link keeps a reference
    to a stored one.  reset always sets: to its default where the rule is
    ('reset', default) and there is one, else the field is left out.  exclude
    leaves it out.
    """
    out = dict(target)
    for name, value in source.items():
        rule = rules.get(name, "copy")
        default = None
        if isinstance(rule, tuple):
            rule, default = rule
            if default is None:
                continue
            value = default
        if rule == "reset":
            out[name] = copy.deepcopy(value)
        elif rule == "link" and name not in out:
            out[name] = model.Ref(f"{path}.{name}") if path else value
        elif rule == "copy" and name not in out:
            out[name] = copy.deepcopy(value)
    return out


def from_template(rows: DataFrame, template: Mapping[str, object], rules: Mapping[str, tuple[str, object]]) -> DataFrame:
    """New records: every row over a template.  ``rules`` gives a field's rule and
    default; own values of copied fields win where they are not null."""
    columns: list[Column] = []
    for name in [*rows.columns, *[n for n in template if n not in rows.columns]]:
        rule, default = rules.get(name, ("copy", None))
        if rule == "exclude":
            continue
        if rule == "reset":
            if default is not None:
                columns.append(F.lit(default).alias(name))
            continue
        own = F.col(name) if name in rows.columns else None
        base = F.lit(template[name]) if name in template else None
        columns.append((own if base is None else base if own is None else F.coalesce(own, base)).alias(name))
    return rows.select(*columns)


def inherit(sources: Sequence[Mapping[str, Column]], props: Mapping[str, Column] | None = None, resets: Sequence[int] = ()) -> dict[str, Column]:
    """Fields of several sources, earlier ones first; sources in ``resets`` always
    set theirs; props come last."""
    out: dict[str, Column] = {}
    for k, source in enumerate(sources):
        for name, column in source.items():
            if k in resets:
                out[name] = column
            else:
                out[name] = F.coalesce(out[name], column) if name in out else column
    return out | dict(props or {})


def cascade_nearest(paths: DataFrame, settings: DataFrame, path: str = "path", name: str = "name") -> DataFrame:
    """Every path with the value that its nearest ancestor, itself included,
    cascades for ``name``.

    ``settings`` (owner, name, value) are marked fields.  Ancestors are exploded,
    as many as a path has parts, and joined on equality; ``max_by`` depth keeps
    the nearest.
    """
    parts = F.split(F.col(path), "\\.")
    depths = F.sequence(F.lit(1), F.size(parts))
    wide = paths.select(path, F.explode(F.transform(depths, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("owner")))).alias("a"))
    own = wide.select(path, F.col("a.depth").alias("depth"), F.col("a.owner").alias("ancestor"))
    hits = own.join(settings, F.col("ancestor") == F.col("owner"))
    nearest = hits.groupBy(path, name).agg(F.max_by("value", "depth").alias("value"), F.max_by("owner", "depth").alias("owner"))
    return nearest
