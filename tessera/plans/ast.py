"""Syntax trees of the SQL dialect: what the parser makes and the binder and planner read."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    text: str  # `column` or `alias.column`


@dataclass(frozen=True)
class Literal:
    value: int | float | str


Operand = Name | Literal


@dataclass(frozen=True)
class Comparison:
    left: Operand
    op: str  # <, > or =
    right: Operand


#: AND of ORs of comparisons.
CNF = tuple[tuple[Comparison, ...], ...]


@dataclass(frozen=True)
class Negative:
    of: Expression


@dataclass(frozen=True)
class Arithmetic:
    op: str  # + - * /
    left: Expression
    right: Expression


Expression = Name | Literal | Negative | Arithmetic


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...]
    tables: tuple[tuple[str, str], ...]  # table, alias
    where: CNF = ()
    group_by: tuple[str, ...] = ()
    sum: Expression | None = None
    sum_distinct: bool = False
    distinct: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...]  # name, INTEGER | DOUBLE | STRING
    sorted_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Insert:
    file: str
    table: str


@dataclass(frozen=True)
class Drop:
    table: str


@dataclass(frozen=True)
class SetOutput:
    target: str  # NONE, STDOUT or a file
    is_file: bool = field(default=False)


@dataclass(frozen=True)
class Exit:
    pass


Statement = Select | CreateTable | Insert | Drop | SetOutput | Exit


def render(x: Operand | Expression) -> str:
    """As it may be written in the dialect, every operation in parentheses."""
    if isinstance(x, Name):
        return x.text
    if isinstance(x, Literal):
        return f"'{x.value}'" if isinstance(x.value, str) else str(x.value)
    if isinstance(x, Negative):
        return f"-({render(x.of)})"
    return f"({render(x.left)} {x.op} {render(x.right)})"


def render_cnf(cnf: CNF) -> str:
    return " AND ".join("(" + " OR ".join(f"{render(c.left)} {c.op} {render(c.right)}" for c in clause) + ")" for clause in cnf)


def names(x: Operand | Expression) -> set[str]:
    if isinstance(x, Name):
        return {x.text}
    if isinstance(x, Negative):
        return names(x.of)
    return names(x.left) | names(x.right) if isinstance(x, Arithmetic) else set()


def clause_names(clause: tuple[Comparison, ...]) -> set[str]:
    return set().union(*(names(c.left) | names(c.right) for c in clause))
