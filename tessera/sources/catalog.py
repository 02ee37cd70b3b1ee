"""Schemas as text: blocks of BEGIN, table, file, lines of `attribute Type`, END, with the types Int, Double and String."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {"Int": T.IntegerType(), "Double": T.DoubleType(), "String": T.StringType()}
#: Names of types in CREATE TABLE.
DDL_TYPES = {"INTEGER": "Int", "DOUBLE": "Double", "STRING": "String"}


@dataclass
class Table:
    name: str
    file: str
    columns: list[tuple[str, str]]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[t]) for n, t in self.columns])


class Catalog:
    """Tables by name."""

    def __init__(self, tables: dict[str, Table] | None = None):
        self.tables = tables or {}

    @classmethod
    def parse(cls, text: str) -> Catalog:
        found: dict[str, Table] = {}
        words = text.split()
        at = 0
        while at < len(words):
            if words[at] != "BEGIN" or "END" not in words[at:]:
                raise ValueError(f"expected BEGIN ... END, found {words[at]!r}")
            end = words.index("END", at)
            name, file, *rest = words[at + 1 : end]
            columns = list(zip(rest[::2], rest[1::2]))
            if len(rest) % 2 or any(t not in TYPES for _, t in columns):
                raise ValueError(f"bad attribute type in {name}")
            if name in found:
                raise ValueError(f"{name} is there twice")
            found[name] = Table(name, file, columns)
            at = end + 1
        return cls(found)

    def text(self) -> str:
        return "".join(f"BEGIN\n{t.name}\n{t.file}\n" + "".join(f"{n} {k}\n" for n, k in t.columns) + "END\n\n" for t in self.tables.values())

    def lookup(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"there is no table {name}")
        return self.tables[name]

    def add(self, table: Table) -> bool:
        if table.name in self.tables:
            return False
        self.tables[table.name] = table
        return True

    def drop(self, name: str) -> bool:
        return self.tables.pop(name, None) is not None


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Int"
    return "Double" if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) else "String"
