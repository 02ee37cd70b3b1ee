"""The queries of the relational engine over the test tables, each with SQL for the same rows.

Sums of two-decimal columns are taken as decimals, so that the result doesn't hang on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as op
from tessera.plans.parser import parse
from tessera.plans.planner import Plan
from tessera.plans.statistics import Statistics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, MIN(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.replace("{PS}", PARTSUPP)
        return f

    return add


def path(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(path(sf_dir, table))


def exact(df: DataFrame, *columns: str) -> DataFrame:
    """df with these two-decimal columns as decimals."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


def as_double(df: DataFrame) -> DataFrame:
    return df.withColumn("sum", F.col("sum").cast("double"))


def partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.min("l_extendedprice").alias("ps_supplycost"))


def dialect(spark: SparkSession, sf_dir: str, text: str, statistics: Statistics | None = None) -> DataFrame:
    """A SELECT of the dialect over the test tables."""

    def table(name: str) -> DataFrame:
        return exact(partsupp(spark, sf_dir), "ps_supplycost") if name == "partsupp" else read(spark, sf_dir, name)

    return Plan(parse(text), table, statistics).dataframe()


@query("SELECT r_regionkey, r_name FROM region")
def scan_heap(spark, sf_dir):
    return op.project(op.select_file(spark, path(sf_dir, "region")), ["r_regionkey", "r_name"])


@query("SELECT r_regionkey, r_name FROM region WHERE r_name = 'EUROPE'")
def select_eq_string(spark, sf_dir):
    return op.project(op.select_file(spark, path(sf_dir, "region"), "(r_name = 'EUROPE')"), ["r_regionkey", "r_name"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3 AND n_nationkey > 10")
def select_cnf_and(spark, sf_dir):
    return op.project(op.select_file(spark, path(sf_dir, "nation"), "(n_regionkey = 3) AND (n_nationkey > 10)"), ["n_nationkey", "n_name"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')")
def select_cnf_or(spark, sf_dir):
    rows = op.select_file(spark, path(sf_dir, "lineitem"), "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')")
    return op.project(rows, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("SELECT r_regionkey, r_name FROM region WHERE r_name < 'middle east' AND r_regionkey > 1")
def select_string_range(spark, sf_dir):
    return op.project(op.select_file(spark, path(sf_dir, "region"), "(r_name < 'middle east') AND (r_regionkey > 1)"), ["r_regionkey", "r_name"])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey = s_suppkey")
def select_att_att(spark, sf_dir):
    return op.project(op.select_file(spark, path(sf_dir, "supplier"), "(s_suppkey = s_suppkey)"), ["s_suppkey"])


@query("SELECT * FROM (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey = 3) WHERE c_acctbal > 1000.0")
def select_pipe(spark, sf_dir):
    rows = op.project(op.select_file(spark, path(sf_dir, "customer"), "(c_nationkey = 3)"), ["c_custkey", "c_nationkey", "c_acctbal"])
    return op.select_pipe(rows, "(c_acctbal > 1000.0)")


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice > 931.01 AND p_retailprice < 991.3")
def project(spark, sf_dir):
    rows = op.select_file(spark, path(sf_dir, "part"), "(p_retailprice > 931.01) AND (p_retailprice < 991.3)")
    return op.project(rows, ["p_partkey", "p_name", "p_retailprice"])


@query("SELECT CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2)) + (CAST(s_acctbal AS DECIMAL(18,2)) * 1.05)) AS DOUBLE) AS sum FROM supplier")
def sum_double(spark, sf_dir):
    # the factor as a decimal column: a literal of the dialect is a double
    rows = exact(read(spark, sf_dir, "supplier"), "s_acctbal").withColumn("factor", F.lit("1.05").cast("decimal(3,2)"))
    return as_double(op.sum_(rows, "(s_acctbal + (s_acctbal * factor))"))


@query("SELECT CAST(SUM(n.n_nationkey) AS BIGINT) AS sum FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND n.n_name = 'NATION_7'")
def sum_int(spark, sf_dir):
    return dialect(spark, sf_dir, "SELECT SUM (n.n_nationkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_7')")


@query("SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum FROM nation WHERE n_name = 'UNITED STATES'")
def sum_empty(spark, sf_dir):
    return op.sum_(op.select_file(spark, path(sf_dir, "nation"), "(n_name = 'UNITED STATES')"), "n_nationkey")


@query("SELECT CAST(SUM(DISTINCT c_nationkey) AS BIGINT) AS sum FROM customer")
def sum_distinct(spark, sf_dir):
    return op.sum_(read(spark, sf_dir, "customer"), "c_nationkey", distinct=True)


@query("SELECT n.n_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 5")
def join_equi_2way(spark, sf_dir):
    return dialect(spark, sf_dir, "SELECT n.n_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 5)")


@query("SELECT o.o_orderkey, c.c_custkey FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND o.o_totalprice < c.c_acctbal")
def join_equi_residual(spark, sf_dir):
    both = op.join(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), "(o_custkey = c_custkey) AND (o_totalprice < c_acctbal)")
    return op.project(both, ["o_orderkey", "c_custkey"])


@query("SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'")
def join_sort_merge(spark, sf_dir):
    both = op.join(read(spark, sf_dir, "orders"), op.select_file(spark, path(sf_dir, "customer"), "(c_mktsegment = 'BUILDING')"), "(o_custkey = c_custkey)", hint="merge")
    return op.project(both, ["o_orderkey", "c_name"])


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_suppkey < b.l_suppkey")
def join_composite_key(spark, sf_dir):
    text = "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem AS a, lineitem AS b WHERE (a.l_orderkey = b.l_orderkey) AND (a.l_linenumber = b.l_linenumber) AND (a.l_suppkey < b.l_suppkey)"
    return dialect(spark, sf_dir, text)


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r WHERE n.n_nationkey < r.r_regionkey")
def join_theta(spark, sf_dir):
    return op.project(op.join(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), "(n_nationkey < r_regionkey)"), ["n_nationkey", "r_regionkey"])


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r WHERE (n.n_regionkey = r.r_regionkey OR n.n_nationkey = r.r_regionkey)")
def join_or(spark, sf_dir):
    both = op.join(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), "(n_regionkey = r_regionkey OR n_nationkey = r_regionkey)")
    return op.project(both, ["n_nationkey", "r_regionkey"])


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r")
def join_cross(spark, sf_dir):
    return op.project(op.join(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")), ["n_nationkey", "r_regionkey"])


@query("SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1, nation n2 WHERE n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey < n2.n_nationkey")
def join_self(spark, sf_dir):
    text = "SELECT n1.n_name, n2.n_name FROM nation AS n1, nation AS n2 WHERE (n1.n_regionkey = n2.n_regionkey) AND (n1.n_nationkey < n2.n_nationkey)"
    return dialect(spark, sf_dir, text).toDF("a", "b")


@query("SELECT CAST(SUM(CAST(ps.ps_supplycost AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM part p, supplier s, {PS} ps WHERE p.p_partkey=ps.ps_partkey AND s.s_suppkey=ps.ps_suppkey AND s.s_acctbal > 2500.0")
def join_3way(spark, sf_dir):
    text = "SELECT SUM (ps.ps_supplycost) FROM part AS p, supplier AS s, partsupp AS ps WHERE (p.p_partkey = ps.ps_partkey) AND (s.s_suppkey = ps.ps_suppkey) AND (s.s_acctbal > 2500.0)"
    return as_double(dialect(spark, sf_dir, text))


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_extendedprice < 20000.0")
def distinct(spark, sf_dir):
    return op.duplicate_removal(op.project(op.select_file(spark, path(sf_dir, "lineitem"), "(l_extendedprice < 20000.0)"), ["l_suppkey"]))


@query("SELECT DISTINCT n.n_regionkey, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
def distinct_join(spark, sf_dir):
    return dialect(spark, sf_dir, "SELECT DISTINCT n.n_regionkey, r.r_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey)")


@query("SELECT CAST(SUM(n.n_regionkey) AS BIGINT) AS sum, n.n_regionkey FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey GROUP BY n.n_regionkey")
def group_sum_int(spark, sf_dir):
    return dialect(spark, sf_dir, "SELECT SUM (n.n_regionkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) GROUP BY n.n_regionkey")


@query("SELECT CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum, s.s_nationkey FROM supplier s, lineitem l WHERE s.s_suppkey = l.l_suppkey GROUP BY s.s_nationkey")
def group_sum_double(spark, sf_dir):
    both = op.join(exact(read(spark, sf_dir, "lineitem"), "l_extendedprice"), read(spark, sf_dir, "supplier"), "(s_suppkey = l_suppkey)")
    return as_double(op.group_by(both, ["s_nationkey"], "l_extendedprice"))


@query("SELECT CAST(SUM(DISTINCT n.n_nationkey + r.r_regionkey) AS BIGINT) AS sum, r.r_regionkey FROM nation n, region r, customer c WHERE n.n_regionkey=r.r_regionkey AND n.n_nationkey=c.c_nationkey AND n.n_nationkey > 10 GROUP BY r.r_regionkey")
def group_sum_distinct(spark, sf_dir):
    text = "SELECT SUM DISTINCT (n.n_nationkey + r.r_regionkey) FROM nation AS n, region AS r, customer AS c WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey = c.c_nationkey) AND (n.n_nationkey > 10) GROUP BY r.r_regionkey"
    return dialect(spark, sf_dir, text)


@query("SELECT CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_multi_key(spark, sf_dir):
    return as_double(op.group_by(exact(read(spark, sf_dir, "lineitem"), "l_quantity"), ["l_returnflag", "l_linestatus"], "l_quantity"))


@query("SELECT CAST(SUM(CAST(ps.ps_supplycost AS DECIMAL(18,2))) AS DOUBLE) AS sum, s.s_suppkey FROM part p, supplier s, {PS} ps WHERE p.p_partkey=ps.ps_partkey AND s.s_suppkey=ps.ps_suppkey AND s.s_acctbal > 2500.0 GROUP BY s.s_suppkey")
def group_3way(spark, sf_dir):
    text = "SELECT SUM (ps.ps_supplycost), s.s_suppkey FROM part AS p, supplier AS s, partsupp AS ps WHERE (p.p_partkey = ps.ps_partkey) AND (s.s_suppkey = ps.ps_suppkey) AND (s.s_acctbal > 2500.0) GROUP BY s.s_suppkey"
    return as_double(dialect(spark, sf_dir, text))


@query("SELECT ROUND(SUM((l_quantity * 2) - (l_extendedprice / 4.0)), 2) AS sum FROM lineitem")
def arith_mixed(spark, sf_dir):
    return op.sum_(read(spark, sf_dir, "lineitem"), "((l_quantity * 2) - (l_extendedprice / 4.0))").select(F.round("sum", 2).alias("sum"))


@query("SELECT CAST(SUM(-CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM supplier")
def arith_neg(spark, sf_dir):
    return as_double(op.sum_(exact(read(spark, sf_dir, "supplier"), "s_acctbal"), "-(s_acctbal)"))


@query("SELECT CAST(SUM((p_size // 7) * 3) AS BIGINT) AS sum FROM part")
def arith_int_division(spark, sf_dir):
    return op.sum_(read(spark, sf_dir, "part"), "((p_size / 7) * 3)")


@query("SELECT c_custkey, CAST(ROW_NUMBER() OVER (ORDER BY c_nationkey, c_custkey) AS BIGINT) AS pos FROM customer")
def sort_order_check(spark, sf_dir):
    """The place of each row in the sorted table, from the order alone: rows before its partition, and before it there."""
    rows = op.sort(op.project(read(spark, sf_dir, "customer"), ["c_nationkey", "c_custkey"]), "(c_nationkey) AND (c_custkey)")
    placed = rows.select("c_custkey", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("at"))
    # sorted once: a second sort samples other borders, and its partitions aren't those that were counted
    placed = placed.checkpoint() if spark.sparkContext.getCheckpointDir() else placed.localCheckpoint()
    sizes = dict(placed.groupBy("part").count().collect())  # a number for each partition
    before, starts = 0, {}
    for part in sorted(sizes):
        starts[part] = before
        before += sizes[part]
    start = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)) if starts else F.create_map(F.lit(0), F.lit(0))
    return placed.select("c_custkey", (start[F.col("part")] + F.col("at") + 1).cast("long").alias("pos"))


_statistics: dict[str, Statistics] = {}


@query("SELECT CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum, n.n_name FROM orders o, customer c, nation n WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1 GROUP BY n.n_name")
def join_ordered(spark, sf_dir):
    """Join order from statistics."""
    if sf_dir not in _statistics:  # gathered once, of the columns that clauses name
        _statistics[sf_dir] = Statistics()
        for name, columns in (("orders", ["o_custkey"]), ("customer", ["c_custkey", "c_nationkey"]), ("nation", ["n_nationkey", "n_regionkey"])):
            _statistics[sf_dir].add_dataframe(name, read(spark, sf_dir, name).select(*columns))
    statistics = _statistics[sf_dir]

    def table(name: str) -> DataFrame:
        return exact(read(spark, sf_dir, name), "o_totalprice") if name == "orders" else read(spark, sf_dir, name)

    text = "SELECT SUM (o.o_totalprice), n.n_name FROM orders AS o, customer AS c, nation AS n WHERE (o.o_custkey = c.c_custkey) AND (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = 1) GROUP BY n.n_name"
    return as_double(Plan(parse(text), table, statistics).dataframe())
