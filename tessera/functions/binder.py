"""From syntax trees to Columns: strict about names and types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans import ast


class BindError(ValueError):
    pass


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Scope:
    """The columns that names may mean: of one DataFrame, or of several under aliases."""

    def __init__(self, fields: list[tuple[str, str, T.DataType, Column]]):
        """fields: alias (or nothing), name, type, column."""
        self.fields = fields

    @classmethod
    def of(cls, df: DataFrame) -> Scope:
        return cls([("", f.name, f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields])

    @classmethod
    def aliased(cls, frames: list[tuple[str, DataFrame]]) -> Scope:
        return cls([(alias, f.name, f.dataType, F.col(f"{alias}.`{f.name}`")) for alias, df in frames for f in df.schema.fields])

    def find(self, text: str) -> tuple[str, str, T.DataType, Column]:
        alias, _, name = text.rpartition(".")
        found = [f for f in self.fields if f[1] == name and (not alias or f[0] == alias)] or [f for f in self.fields if f[1] == text]
        if not found:
            raise BindError(f"there is no column {text}")
        if len(found) > 1:
            raise BindError(f"{text} is ambiguous")
        return found[0]

    def aliases(self, names: set[str]) -> set[str]:
        return {self.find(n)[0] for n in names}


def operand(x: ast.Operand, scope: Scope) -> tuple[Column, T.DataType]:
    if isinstance(x, ast.Name):
        _, _, kind, column = scope.find(x.text)
        return column, kind
    kind = {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(x.value)]
    return F.lit(x.value), kind


def comparison(c: ast.Comparison, scope: Scope, strict: bool = False) -> Column:
    """strict: both sides must have the same type, as with `x > 2500` for a Double x being an error."""
    (left, a), (right, b) = operand(c.left, scope), operand(c.right, scope)
    numbers = isinstance(a, NUMERIC), isinstance(b, NUMERIC)
    if numbers[0] != numbers[1] and (isinstance(a, T.StringType) or isinstance(b, T.StringType)) and any(numbers):
        raise BindError(f"{ast.render(c.left)} {c.op} {ast.render(c.right)}: a string and a number")
    if strict and isinstance(a, WHOLE) != isinstance(b, WHOLE):
        raise BindError(f"{ast.render(c.left)} {c.op} {ast.render(c.right)}: an integer and a double")
    return {"<": left < right, ">": left > right, "=": left == right}[c.op]


def clause(parts: tuple[ast.Comparison, ...], scope: Scope, strict: bool = False) -> Column:
    return reduce(Column.__or__, [comparison(c, scope, strict) for c in parts])


def predicate(cnf: ast.CNF, scope: Scope, strict: bool = False) -> Column:
    return reduce(Column.__and__, [clause(c, scope, strict) for c in cnf], F.lit(True)) if cnf else F.lit(True)


def arithmetic(x: ast.Expression, scope: Scope) -> tuple[Column, T.DataType]:
    """Column and type. Integers divide to an integer, towards zero; an integer with a double gives a double."""
    if isinstance(x, ast.Negative):
        column, kind = arithmetic(x.of, scope)
        return -column, kind
    if not isinstance(x, ast.Arithmetic):
        column, kind = operand(x, scope)
        if not isinstance(kind, NUMERIC):
            raise BindError(f"{ast.render(x)} is no number")
        if isinstance(x, ast.Literal) and isinstance(x.value, int) and abs(x.value) < 2**31:
            return column, T.IntegerType()
        return column, kind
    (left, a), (right, b) = arithmetic(x.left, scope), arithmetic(x.right, scope)
    whole = isinstance(a, WHOLE) and isinstance(b, WHOLE)
    if x.op == "/":
        column = F.call_function("div", left, right) if whole else left / right
    else:
        column = {"+": left + right, "-": left - right, "*": left * right}[x.op]
    if whole:
        return column, T.LongType() if isinstance(a, T.LongType) or isinstance(b, T.LongType) or x.op == "/" else T.IntegerType()
    decimal = isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType)
    return column, T.DecimalType() if decimal and not isinstance(a, T.DoubleType) and not isinstance(b, T.DoubleType) else T.DoubleType()


def result_is_integer(x: ast.Expression, scope: Scope) -> bool:
    return isinstance(arithmetic(x, scope)[1], WHOLE)
