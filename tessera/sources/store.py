"""Tables on storage: heap (any order) and sorted (by a key), as Parquet.

A table is a folder with versions and a small file that names the one in use. An append to a heap adds files to its version. A sorted table keeps
appended rows as a pending heap beside its version; the next read (or close) merges them: both are range-partitioned and sorted by the key
into a new version, and the pointer moves. A reader never sees a version that is being written, and the one that it has opened stays until the merge after the next.
Row groups of a sorted table are small and have narrow minima and maxima, so equality on a prefix of the key skips most of them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import binder
from tessera.plans import ast
from tessera.plans.parser import parse_cnf
from tessera.sources.files import Files
from tessera.sources.tbl import read_tbl

KINDS = ("heap", "sorted")
#: Bytes of a row group of a sorted table.
ROW_GROUP = 16 << 20


class StoredTable:
    """One open table."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta, self.files = spark, path.rstrip("/"), meta, Files(spark)
        self.schema = T.StructType.fromJson(meta["schema"])

    @property
    def kind(self) -> str:
        return self.meta["kind"]

    @property
    def order(self) -> list[str]:
        return self.meta["order"]

    def _save(self) -> None:
        self.files.write(f"{self.path}/table.json", json.dumps(self.meta))

    def _refresh(self) -> None:
        """Takes in what other handles have done."""
        self.meta = json.loads(self.files.read(f"{self.path}/table.json"))

    def _read(self, folder: str | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")

    def append(self, df: DataFrame) -> None:
        """Rows of df, which has the table's columns."""
        df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields))
        self._refresh()
        field = "version" if self.kind == "heap" else "pending"
        if self.meta[field] is None:
            self.meta[field] = f"{field}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(f"{self.path}/{self.meta[field]}")
        self._save()

    def add(self, *rows: tuple) -> None:
        self.append(self.spark.createDataFrame(list(rows), self.schema))

    def load(self, tbl_path: str) -> None:
        """Appends a text table."""
        self.append(read_tbl(self.spark, tbl_path, self.schema))

    def merge(self) -> None:
        """Brings pending rows of a sorted table into a new version."""
        self._refresh()
        if self.meta["pending"] is None:
            return
        old = [self.meta["version"], self.meta["pending"]]
        both = self._read(old[1]) if old[0] is None else self._read(old[0]).unionByName(self._read(old[1]))
        new = f"version-{uuid.uuid4().hex}"
        both.repartitionByRange(*self.order).sortWithinPartitions(*self.order).write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{new}")
        gone = self.meta.get("old", [])
        self.meta |= {"version": new, "pending": None, "old": [folder for folder in old if folder is not None]}
        self._save()
        for folder in gone:
            self.files.delete(f"{self.path}/{folder}")

    def scan(self, predicate: str | ast.CNF = "") -> DataFrame:
        """All rows, or those for which the predicate holds; it reaches the Parquet scan."""
        self.merge()
        df = self._read(self.meta["version"])
        cnf = parse_cnf(predicate) if isinstance(predicate, str) else predicate
        return df.filter(binder.predicate(cnf, binder.Scope.of(df))) if cnf else df

    def key_prefix(self, predicate: str | ast.CNF) -> list[str]:
        """The longest prefix of the sort key that single equalities with a literal bind: what row groups are skipped by."""
        cnf = parse_cnf(predicate) if isinstance(predicate, str) else predicate
        bound = {c.left.text if isinstance(c.left, ast.Name) else c.right.text for (c, *more) in cnf if not more and c.op == "=" and isinstance(c.left, ast.Name) != isinstance(c.right, ast.Name)}
        out = []
        for name in self.order:
            if name not in bound:
                break
            out.append(name)
        return out

    def close(self) -> int:
        self.merge()
        return 1


class TableStore:
    """Tables below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.files.exists(f"{self.path(name)}/table.json")

    def create(self, name: str, schema: T.StructType, kind: str = "heap", order: list[str] | tuple[str, ...] = (), run_length: int = 100) -> bool:
        """False if the table is there already. A sorted table needs its key; run_length is kept with it, and Spark sorts with the memory it has."""
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
        if (kind == "sorted") != bool(order) or any(c not in schema.names for c in order):
            raise ValueError("a sorted table has a key of its own columns, a heap none")
        if self.exists(name):
            return False
        meta = {"kind": kind, "order": list(order), "run_length": run_length, "schema": schema.jsonValue(), "version": None, "pending": None}
        self.files.write(f"{self.path(name)}/table.json", json.dumps(meta))
        return True

    def open(self, name: str) -> StoredTable | None:
        """None if there is no such table."""
        if not self.exists(name):
            return None
        return StoredTable(self.spark, self.path(name), json.loads(self.files.read(f"{self.path(name)}/table.json")))

    def load_and_scan(self, name: str, tbl_path: str, schema: T.StructType, predicate: str = "", kind: str = "heap", order: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """Loads a text table into the table of that name, which is created if need be, and scans it."""
        self.create(name, schema, kind, order)
        table = self.open(name)
        table.load(tbl_path)
        return table.scan(predicate)

    def drop(self, name: str) -> bool:
        return self.exists(name) and self.files.delete(self.path(name))


def scan_text(spark: SparkSession, path: str, schema: T.StructType, predicate: str = "") -> DataFrame:
    """A text table filtered without being loaded."""
    df = read_tbl(spark, path, schema)
    return df.filter(binder.predicate(parse_cnf(predicate), binder.Scope.of(df))) if predicate else df
