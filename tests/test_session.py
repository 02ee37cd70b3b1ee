import io

import pytest

from tessera.functions.binder import BindError
from tessera.plans.planner import Plan
from tessera.session import Session

TC = {
    "tc2": ("SELECT n.n_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 5)", 4),
    "tc3": ("SELECT SUM (n.n_nationkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'N7')", 1),
    "tc4": ("SELECT SUM (n.n_regionkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) GROUP BY n.n_regionkey", 3),
    "tc5": ("SELECT SUM DISTINCT (n.n_nationkey + r.r_regionkey) FROM nation AS n, region AS r, nation AS m WHERE (n.n_regionkey = r.r_regionkey) AND (m.n_nationkey = n.n_nationkey) GROUP BY r.r_regionkey", 3),
}


@pytest.fixture
def session(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("".join(f"{k}|N{k}|{k % 3}|\n" for k in range(10)))
    (tmp_path / "region.tbl").write_text("0|AFRICA|\n1|ASIA|\n2|EUROPE|\n")
    s = Session(spark, str(tmp_path / "db"), str(tmp_path), out=io.StringIO())
    s.run_script("""
        CREATE TABLE nation (n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER) AS HEAP;
        CREATE TABLE region (r_regionkey INTEGER, r_name STRING) AS SORTED ON r_name;
        INSERT 'nation.tbl' INTO nation;
        INSERT 'region.tbl' INTO region
    """)
    return s


@pytest.mark.parametrize("name", TC)
def test_statements(session, name):
    text, n = TC[name]
    df = session.sql(text)
    assert df.count() == n and session.out.getvalue().endswith(f"{n} records found!\n")
    session.analyze("nation")
    session.analyze("region")
    assert sorted(map(tuple, session.query(text).collect())) == sorted(map(tuple, df.collect()))


def test_plan_only(session):
    session.sql("SET OUTPUT NONE")
    session.sql(TC["tc5"][0])
    told = session.out.getvalue()
    assert told.count("SELECT FILE") == 3 and told.count("JOIN OPERATION") == 2 and "Distinct: True" in told and "sum: Int, r.r_regionkey: Int" in told
    session.sql("SELECT SUM (n.n_nationkey + 1.5) FROM nation AS n")
    assert "sum: Double" in session.out.getvalue()
    session.sql("SELECT DISTINCT n_regionkey FROM nation")
    assert "DUPLICATE REMOVAL" in session.out.getvalue()


def test_output_file(session, spark, tmp_path):
    session.run_script(f"SET OUTPUT '{tmp_path}/rows'; SELECT n_name FROM nation WHERE (n_nationkey < 2)")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/rows").collect()) == ["n_name: N0", "n_name: N1"]


def test_ddl_is_kept(session, spark):
    again = Session(spark, session.root, session.data)
    assert set(again.catalog.tables) == {"nation", "region"} and again.table("region").first().r_name == "AFRICA"
    assert again.statistics.relations["nation"].tuples == 10  # INSERT counts
    again.sql("DROP TABLE nation")
    assert set(Session(spark, session.root).catalog.tables) == {"region"} and not again.store.exists("nation")
    with pytest.raises(KeyError):
        again.sql("DROP TABLE nation")
    with pytest.raises(ValueError):
        again.sql("CREATE TABLE region (a INTEGER) AS HEAP")


def test_repl_and_exit(session):
    session.repl(iter(["SELECT n_name\n", "FROM nation WHERE (n_nationkey = 3);\n", "SELECT x FROM nation;\n", "EXIT;\n", "DROP TABLE nation;\n"]))
    said = session.out.getvalue()
    assert "n_name: [N3]\n1 records found!" in said and "error: there is no column x" in said and "nation" in session.catalog.tables


@pytest.mark.parametrize(
    "text",
    [
        "SELECT n_name FROM nation WHERE (nothing = 1)",
        "SELECT n_name FROM nation GROUP BY n_name",
        "SELECT SUM (n_nationkey), n_name FROM nation",
        "SELECT n_name FROM nation AS a, region AS a",
        "SELECT n_name FROM nation AS a, nation AS b",
    ],
)
def test_errors(session, text):
    with pytest.raises(BindError):
        session.query(text)


def test_written_order_and_self_join(session):
    assert session.query("SELECT n_regionkey, n_name FROM nation").columns == ["n_regionkey", "n_name"]
    df = session.query("SELECT a.n_name, b.n_name FROM nation AS a, nation AS b WHERE (a.n_regionkey = b.n_regionkey) AND (a.n_nationkey < b.n_nationkey)")
    assert df.columns == ["a.n_name", "b.n_name"] and df.count() == 12
    assert session.query("SELECT SUM DISTINCT (n_regionkey) FROM nation").first()[0] == 3


def test_or_across_tables_is_a_join_condition(session):
    plan = session.plan("SELECT n.n_name FROM nation AS n, region AS r WHERE (n.n_nationkey = r.r_regionkey OR n.n_regionkey = r.r_regionkey)")
    assert isinstance(plan, Plan) and plan.dataframe().count() == len([1 for k in range(10) for r in range(3) if k == r or k % 3 == r])


def test_right_associative_session(spark, tmp_path):
    s = Session(spark, str(tmp_path / "db"), right_associative=True, out=io.StringIO())
    s.register("t", spark.createDataFrame([(9, 4, 3)], "a int, b int, c int"))
    assert s.query("SELECT SUM (a - b - c) FROM t").first()[0] == 8
