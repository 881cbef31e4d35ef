"""Dotted paths: validity, kinds and the names that are reserved."""

from __future__ import annotations

import re

NAME = re.compile(r"[^\W\d]\w{0,254}|@\w+|\w+")
#: Heads that mean something by themselves.
RESERVED = ("my", "world", "scope")


class PathProblem(ValueError):
    pass


def parts_of(path: str) -> list[str]:
    """The names of a path; raises where one is empty or not a name."""
    parts = path.split(".")
    for part in parts:
        if not NAME.fullmatch(part):
            raise PathProblem(f"invalid path component {part!r} in {path!r}")
    return parts


def kind_of_path(path: str, bridges: tuple[str, ...] = ()) -> str:
    """'world', 'local' (the agent's home or machine) or 'bridge' (another tree)."""
    parts = parts_of(path)
    if parts[0] == "my" and len(parts) > 2 and parts[1] in bridges and parts[2] == "world":
        return "bridge"
    return "world" if parts[0] == "world" else "local"


def resolve(path: str, agent: int) -> str:
    """``my`` is the agent's home, but for ``my.computer``, which stays."""
    parts = path.split(".")
    if parts[0] == "my" and parts[1:2] != ["computer"]:
        return ".".join(["world", "agent", str(agent), *parts[1:]])
    return path


def home(agent: int) -> str:
    return f"world.agent.{agent}"


def is_below(path: str, ancestor: str) -> bool:
    return path == ancestor or path.startswith(ancestor + ".")


def rebased(path: str, old: str, new: str) -> str:
    """A path moved from under ``old`` to under ``new``."""
    if not is_below(path, old):
        raise PathProblem(f"{path!r} is not below {old!r}")
    return new + path[len(old) :]
