"""Statements and expressions as the parser gives them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Literal:
    value: int | float | str


@dataclass
class Ref:
    table: str | None
    name: str


@dataclass
class Unary:
    op: str
    operand: Expr


@dataclass
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass
class Call:
    name: str
    argument: Expr | None  # None: count(*)


Expr = Literal | Ref | Unary | Binary | Call


@dataclass
class Table:
    name: str
    alias: str | None = None
    columns: list[str] | None = None


@dataclass
class Derived:
    query: Select
    alias: str | None = None
    columns: list[str] | None = None


@dataclass
class Values:
    rows: list[list[Literal]]
    alias: str | None = None
    columns: list[str] | None = None


@dataclass
class Join:
    left: Source
    right: Source
    on: Expr | None


Source = Table | Derived | Values | Join


@dataclass
class Item:
    expr: Expr | None  # None: *
    alias: str | None = None


@dataclass
class Select:
    items: list[Item]
    sources: list[Source] = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] | None = None
    having: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass
class Insert:
    table: str
    rows: Values | Select


@dataclass
class Delete:
    table: str
    where: Expr | None


@dataclass
class Update:
    table: str
    changes: list[tuple[str, Expr]]
    sources: list[Source]
    where: Expr | None


@dataclass
class ColumnDef:
    name: str
    type: object
    primary: bool = False
    auto: bool = False
    references: tuple[str, str] | None = None


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]


@dataclass
class DropTable:
    name: str


@dataclass
class IndexStatement:
    """Create or drop an index: accepted, without effect."""

    name: str
