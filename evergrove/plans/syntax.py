"""Syntax tree of the path language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Interpolated(Node):
    parts: tuple  # str or Path


@dataclass(frozen=True)
class Path(Node):
    """Names, in order; a name may be an expression in brackets (``Key``)."""

    parts: tuple

    @property
    def plain(self) -> bool:
        return all(isinstance(p, str) for p in self.parts)

    def dotted(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Link(Node):
    path: Path


@dataclass(frozen=True)
class UnknownMatch(Node):
    """``unknown`` without a reason."""


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple


@dataclass(frozen=True)
class RecordOf(Node):
    fields: tuple  # (name, modifier or None, expression)


@dataclass(frozen=True)
class Bracket(Node):
    base: Node
    filters: tuple


@dataclass(frozen=True)
class Projection(Node):
    base: Node
    names: tuple  # 'a', 'p_*', '*'
    excluded: tuple = ()


@dataclass(frozen=True)
class Field(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class CollectionOp(Node):
    base: Node
    op: str
    args: tuple


@dataclass(frozen=True)
class Procedure(Node):
    name: str | None
    params: tuple
    body: tuple


@dataclass(frozen=True)
class Watch(Node):
    paths: tuple
    body: tuple
    append: bool = False
    filters: tuple = ()
    binding: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class New(Node):
    type_name: str | None
    modifier: str | None
    sources: tuple
    props: RecordOf | None = None


# --- statements -------------------------------------------------------------------


@dataclass(frozen=True)
class Assign(Node):
    target: Path
    value: Node
    modifiers: tuple = ()
    definition: bool = False


@dataclass(frozen=True)
class If(Node):
    branches: tuple  # (condition, block)
    otherwise: tuple = ()


@dataclass(frozen=True)
class While(Node):
    condition: Node
    body: tuple


@dataclass(frozen=True)
class For(Node):
    name: str
    index: str | None
    items: Node
    body: tuple


@dataclass(frozen=True)
class Consider(Node):
    subject: Node
    cases: tuple
    default: tuple = ()


@dataclass(frozen=True)
class Catch(Node):
    body: tuple
    handler: tuple


@dataclass(frozen=True)
class Quietly(Node):
    body: tuple


@dataclass(frozen=True)
class Scope(Node):
    path: Path


@dataclass(frozen=True)
class Return(Node):
    value: Node | None


@dataclass(frozen=True)
class Break(Node):
    pass


@dataclass(frozen=True)
class Pass(Node):
    pass


@dataclass(frozen=True)
class Embed(Node):
    path: Path


@dataclass
class Program:
    statements: list = field(default_factory=list)
