import pytest
from pyspark.sql.utils import AnalysisException

from tessera.functions.binder import BindError, Scope, result_is_integer
from tessera.operators import relational as op
from tessera.plans.parser import parse_expression


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, 2.5, "b"), (2, -1.0, "a"), (2, 4.0, "B"), (7, 4.0, "a")], "k int, x double, s string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_scan(spark, data):
    df = op.project(op.select_file(spark, f"{data}/lineitem.parquet", "(l_suppkey = 3) AND (l_quantity < 10.0)"), ["l_orderkey"])
    assert "PushedFilters: [IsNotNull(l_suppkey)" in plan(df) and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan(df)


def test_predicates(t):
    assert rows(op.select_pipe(t, "(s > 'B')")) == [(1, 2.5, "b"), (2, -1.0, "a"), (7, 4.0, "a")]  # bytes decide: 'a' > 'B'
    assert len(rows(op.select_pipe(t, "(k = 1 OR x = 4.0) AND (s = 'a' OR s = 'b' OR k < 2)"))) == 2
    assert rows(op.select_pipe(t, "(2 = k) AND (x < 0.0)")) == [(2, -1.0, "a")]
    assert len(rows(op.select_pipe(t, "(1 = 1)"))) == 4 and op.select_pipe(t).count() == 4


def test_strictness(t):
    for bad in ("(nothing = 1)", "(k = 'a')"):
        with pytest.raises(BindError):
            op.select_pipe(t, bad)
    assert op.select_pipe(t, "(x > 2)").count() == 3
    with pytest.raises(BindError):
        op.select_pipe(t, "(x > 2)", strict=True)
    with pytest.raises(BindError):
        op.sum_(t, "s + 1")
    with pytest.raises(BindError):
        op.project(t, ["k", "none"])


def test_join_keeps_the_rest_of_its_predicate(t):
    other = t.toDF("k2", "x2", "s2")
    assert len(rows(op.join(t, other, "(k = k2) AND (x < x2)"))) == 1
    assert len(rows(op.join(t, other, "(s = s2)"))) == 6  # strings as keys
    assert len(rows(op.join(t, t, "(l.k = r.k)"))) == 6
    assert len(rows(op.join(t, other))) == 16
    assert len(rows(op.join(t, other, "(k < k2 OR s = s2)"))) == len([1 for a in rows(t) for b in rows(other) if a[0] < b[0] or a[2] == b[2]])
    assert "SortMergeJoin" in plan(op.join(t, other, "(k = k2)", hint="merge"))


def test_sums(t, spark):
    assert rows(op.sum_(t, "k")) == [(12,)] and rows(op.sum_(t, "k", distinct=True)) == [(10,)]
    assert rows(op.sum_(op.select_pipe(t, "(k > 99)"), "k")) == [(None,)]
    assert sorted(rows(op.group_by(t, ["k"], "x * 2"))) == [(5.0, 1), (6.0, 2), (8.0, 7)]
    assert sorted(rows(op.group_by(t, ["s", "k"], "k", distinct=True))) == [(1, "b", 1), (2, "B", 2), (2, "a", 2), (7, "a", 7)]
    precise = spark.createDataFrame([(1, 1234567.891)], "k int, x double")
    assert rows(op.group_by(precise, ["k"], "x")) == [(1234567.891, 1)]
    assert op.duplicate_removal(op.select_pipe(t, "(k > 99)")).count() == 0
    assert op.duplicate_removal(op.project(t, ["x"])).count() == 3


def test_arithmetic(spark):
    one = spark.createDataFrame([(7, -7, 2, 1.5)], "a int, b int, c int, d double")
    v = lambda text, **k: rows(op.sum_(one, text, **k))[0][0]
    assert v("a / c") == 3 and v("b / c") == -3 and v("a / d") == pytest.approx(14 / 3) and v("-(a)") == -7
    assert v("a - c - c") == 3 and v("a - c - c", right_associative=True) == 7
    assert v("c * c + a") == 11 and v("c * c + a", right_associative=True) == 18
    scope = Scope.of(one)
    assert result_is_integer(parse_expression("a * c - 1"), scope) and not result_is_integer(parse_expression("a + d"), scope)
    with pytest.raises(Exception, match="(?i)divi"):
        v("a / (c - 2)")


def test_sort(t):
    assert [r[0] for r in rows(op.sort(t, "(k) AND (s)"))] == [1, 2, 2, 7]
    assert [r[2] for r in rows(op.sort(t, "(s) AND (x)"))] == ["B", "a", "a", "b"]
    assert op.all_column_order(t.select("s", "x", "k")) == ["k", "x", "s"]
    assert rows(op.sort_all(t))[1] == (2, -1.0, "a")


def test_sinks(t, spark, tmp_path):
    assert op.lines(op.sort(t, "k")).first().value == "k: 1|x: 2.500000|s: b"
    assert op.lines(op.sort(t, "k"), "screen").first().value == "k: [1], x: [2.500000], s: [b]"
    assert op.lines(op.sort(t, "k"), "record").first().value == "k:[1], x:[2.500000], s:[b], "
    op.write_out(t, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_ambiguous_name(t):
    with pytest.raises((BindError, AnalysisException)):
        op.join(t, t, "(k = k)")
