"""A session of the SQL dialect: SELECT, CREATE TABLE, INSERT, DROP TABLE, SET OUTPUT, EXIT."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import relational
from tessera.plans import ast
from tessera.plans.parser import parse, split_script
from tessera.plans.planner import Plan
from tessera.plans.statistics import Statistics
from tessera.sources.catalog import DDL_TYPES, Catalog, Table
from tessera.sources.files import Files
from tessera.sources.store import TableStore
from tessera.sources.tbl import read_tbl


class Session:
    """Tables below a folder, with their catalog and statistics; other DataFrames can be registered as tables.

    output: NONE prints the plan, STDOUT the rows, anything else is a folder for text. right_associative: arithmetic without precedence, to the right.
    """

    def __init__(self, spark: SparkSession, root: str, data: str = "", right_associative: bool = False, out=None):
        self.spark, self.root, self.data, self.right_associative = spark, root.rstrip("/"), data, right_associative
        self.out = out or sys.stdout
        self.files, self.store = Files(spark), TableStore(spark, f"{self.root}/tables")
        self.catalog = Catalog.parse(self.files.read(f"{self.root}/catalog")) if self.files.exists(f"{self.root}/catalog") else Catalog()
        self.statistics = Statistics.parse(self.files.read(f"{self.root}/statistics")) if self.files.exists(f"{self.root}/statistics") else Statistics()
        self.registered: dict[str, DataFrame] = {}
        self.output, self.running = "STDOUT", True

    def register(self, name: str, df: DataFrame, analyze: bool = False) -> None:
        self.registered[name] = df
        if analyze:
            self.statistics.add_dataframe(name, df)

    def analyze(self, name: str) -> None:
        """Counts a table's rows and distinct values, for the order of joins."""
        self.statistics.add_dataframe(name, self.table(name))
        self._save()

    def table(self, name: str) -> DataFrame:
        if name in self.registered:
            return self.registered[name]
        self.catalog.lookup(name)
        return self.store.open(name).scan()

    def _save(self) -> None:
        self.files.write(f"{self.root}/catalog", self.catalog.text())
        self.files.write(f"{self.root}/statistics", self.statistics.text())

    def plan(self, text: str | ast.Select) -> Plan:
        query = parse(text, self.right_associative) if isinstance(text, str) else text
        if not isinstance(query, ast.Select):
            raise ValueError("only a SELECT has a plan")
        return Plan(query, self.table, self.statistics)

    def query(self, text: str) -> DataFrame:
        """The rows of a SELECT, whatever the output is set to."""
        return self.plan(text).dataframe()

    def sql(self, text: str) -> DataFrame | None:
        """Runs a statement; a SELECT also returns its DataFrame."""
        statement = parse(text, self.right_associative)
        if isinstance(statement, ast.Select):
            return self._select(statement)
        if isinstance(statement, ast.CreateTable):
            self._create(statement)
        elif isinstance(statement, ast.Insert):
            self._insert(statement)
        elif isinstance(statement, ast.Drop):
            self._drop(statement)
        elif isinstance(statement, ast.SetOutput):
            self.output = statement.target
        else:
            self.running = False
        return None

    def run_script(self, text: str) -> list[DataFrame | None]:
        """Statements up to EXIT."""
        out = []
        for statement in split_script(text):
            if not self.running:
                break
            out.append(self.sql(statement))
        return out

    def repl(self, lines: Iterator[str]) -> None:
        """Reads statements that end in a semicolon until EXIT; an error ends its statement only."""
        waiting = ""
        for line in lines:
            waiting += line
            if ";" not in line:
                continue
            try:
                self.run_script(waiting)
            except Exception as e:  # noqa: BLE001
                print(f"error: {e}", file=self.out)
            waiting = ""
            if not self.running:
                return

    def _select(self, statement: ast.Select) -> DataFrame:
        plan = self.plan(statement)
        df = plan.dataframe()
        if self.output == "NONE":
            print(plan.text(), file=self.out)
        elif self.output == "STDOUT":
            n = 0
            for row in relational.lines(df, "screen").toLocalIterator():
                print(row.value, file=self.out)
                n += 1
            print(f"{n} records found!", file=self.out)
        else:
            relational.write_out(df, self.output)
        return df

    def _create(self, s: ast.CreateTable) -> None:
        if s.table in self.catalog.tables or s.table in self.registered:
            raise ValueError(f"there is a table {s.table} already")
        table = Table(s.table, f"{s.table}.tbl", [(n, DDL_TYPES[t]) for n, t in s.columns])
        self.store.create(s.table, table.schema, "sorted" if s.sorted_on else "heap", s.sorted_on)
        self.catalog.add(table)
        self.statistics.add_rel(s.table, 0)
        for n, _ in s.columns:
            self.statistics.add_att(s.table, n, 0)
        self._save()

    def _insert(self, s: ast.Insert) -> None:
        self.catalog.lookup(s.table)
        path = s.file if "/" in s.file or not self.data else f"{self.data}/{s.file}"
        rows = read_tbl(self.spark, path, self.store.open(s.table).schema)
        self.store.open(s.table).append(rows)
        if s.table in self.statistics.relations:
            self.statistics.add_rows(s.table, rows)
            self._save()

    def _drop(self, s: ast.Drop) -> None:
        self.catalog.lookup(s.table)
        self.store.drop(s.table)
        self.catalog.drop(s.table)
        self.statistics.relations.pop(s.table, None)
        self._save()


def main() -> None:
    """python -m tessera.session FOLDER: statements from standard input."""
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    Session(spark, sys.argv[1]).repl(sys.stdin)


if __name__ == "__main__":
    main()
