"""The relational operators, from DataFrame to DataFrame. Predicates and sums are texts of the dialect or parsed trees.

All are declared with DataFrame operations, so Catalyst pushes filters and columns into scans, picks join strategies, and aggregates
before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import binder
from tessera.plans import ast
from tessera.plans.parser import parse_cnf, parse_expression, parse_sort_spec


def _cnf(predicate: str | ast.CNF) -> ast.CNF:
    return parse_cnf(predicate) if isinstance(predicate, str) else predicate


def _expression(x: str | ast.Expression, right_associative: bool = False) -> ast.Expression:
    return parse_expression(x, right_associative) if isinstance(x, str) else x


def select_file(spark: SparkSession, path: str, predicate: str | ast.CNF = "", strict: bool = False) -> DataFrame:
    """Scan of a Parquet table, and the rows for which the predicate holds; it reaches the scan."""
    return select_pipe(spark.read.parquet(path), predicate, strict)


def select_pipe(df: DataFrame, predicate: str | ast.CNF = "", strict: bool = False) -> DataFrame:
    cnf = _cnf(predicate)
    return df.filter(binder.predicate(cnf, binder.Scope.of(df), strict)) if cnf else df


def project(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """These columns in this order."""
    scope = binder.Scope.of(df)
    return df.select(*(scope.find(c)[3] for c in columns))


def join(left: DataFrame, right: DataFrame, predicate: str | ast.CNF = "", left_alias: str = "l", right_alias: str = "r", hint: str | None = None) -> DataFrame:
    """Inner join on the whole predicate: equalities of any number of columns, ranges, ORs across tables, or none (a cross product).

    Columns may be told by alias. The result has the left columns, then the right ones. hint: merge, shuffle_hash or broadcast, else Spark chooses:
    equalities give hash or merge joins, with the rest of the predicate as their condition; other predicates nested loops.
    """
    cnf = _cnf(predicate)
    condition = binder.predicate(cnf, binder.Scope.aliased([(left_alias, left), (right_alias, right)])) if cnf else None
    a, b = left.alias(left_alias), right.alias(right_alias)
    b = b.hint(hint) if hint else b
    return a.join(b, condition, "inner") if condition is not None else a.crossJoin(b)


def duplicate_removal(df: DataFrame) -> DataFrame:
    return df.distinct()


def sum_column(expression: str | ast.Expression, scope: binder.Scope, distinct: bool = False, right_associative: bool = False):
    column, kind = binder.arithmetic(_expression(expression, right_associative), scope)
    return (F.sum_distinct(column) if distinct else F.sum(column)).alias("sum")


def sum_(df: DataFrame, expression: str | ast.Expression, distinct: bool = False, right_associative: bool = False) -> DataFrame:
    """One row, `sum`: of integers a long, else a double; null without rows."""
    return df.agg(sum_column(expression, binder.Scope.of(df), distinct, right_associative))


def group_by(df: DataFrame, keys: list[str] | tuple[str, ...], expression: str | ast.Expression, distinct: bool = False, right_associative: bool = False) -> DataFrame:
    """`sum`, then the keys, one row for each group."""
    scope = binder.Scope.of(df)
    columns = [scope.find(k)[3] for k in keys]
    total = sum_column(expression, scope, distinct, right_associative)
    return df.groupBy(*columns).agg(total).select("sum", *columns)


def sort(df: DataFrame, spec: str | list[str] | tuple[str, ...]) -> DataFrame:
    """Ascending, in a total order of these columns: a range shuffle and sorts that spill."""
    names = parse_sort_spec(spec) if isinstance(spec, str) else spec
    scope = binder.Scope.of(df)
    return df.orderBy(*(scope.find(n)[3] for n in names))


def all_column_order(df: DataFrame) -> list[str]:
    """The columns in the order in which whole rows are compared: integers, then doubles, then strings."""
    rank = lambda t: 0 if isinstance(t, binder.WHOLE) else 1 if isinstance(t, binder.NUMERIC) else 2
    return [f.name for f in sorted(df.schema.fields, key=lambda f: rank(f.dataType))]


def sort_all(df: DataFrame) -> DataFrame:
    return sort(df, all_column_order(df))


def text_value(field: T.StructField):
    """A value as sinks write it: doubles with six decimals."""
    c = F.col(f"`{field.name}`")
    return F.format_string("%f", c) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")


def lines(df: DataFrame, style: str = "file") -> DataFrame:
    """One text column, `value`, with a line for each row. file: `a: 1|b: x`; screen: `a: [1], b: [x]`; record: `a:[1], b:[x], `."""
    before, after, between, end = {"file": (": ", "", "|", ""), "screen": (": [", "]", ", ", ""), "record": (":[", "]", ", ", ", ")}[style]
    parts = [F.concat(F.lit(f.name + before), F.coalesce(text_value(f), F.lit("")), F.lit(after)) for f in df.schema.fields]
    return df.select(F.concat(F.concat_ws(between, *parts), F.lit(end)).alias("value"))


def write_out(df: DataFrame, path: str, style: str = "file") -> None:
    """A folder of text files, one line a row, written by all tasks; styles as in lines."""
    lines(df, style).write.mode("overwrite").text(path)
