import pytest
from pyspark.sql import types as T

from tessera.sources.catalog import Catalog
from tessera.sources.files import Files
from tessera.sources.store import TableStore, scan_text
from tessera.sources.tbl import read_tbl

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


@pytest.fixture
def tbl(tmp_path):
    path = tmp_path / "t.tbl"
    path.write_text("3|1.5| x|\n1|2.0|y|\n2|0.25||\n")
    return str(path)


def test_read_tbl(spark, tbl, tmp_path):
    assert [tuple(r) for r in read_tbl(spark, tbl, SCHEMA).orderBy("a").collect()] == [(1, 2.0, "y"), (2, 0.25, ""), (3, 1.5, " x")]
    (tmp_path / "bad.tbl").write_text("12abc|1.0|x|\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_tbl(spark, str(tmp_path / "bad.tbl"), SCHEMA).collect()
    assert scan_text(spark, tbl, SCHEMA, "(a > 1) AND (b < 1.0)").count() == 1
    assert scan_text(spark, tbl, SCHEMA, "(c = '')").count() == 1


def test_heap(store, tbl):
    assert store.create("t", SCHEMA) and not store.create("t", SCHEMA)
    assert store.open("none") is None
    t = store.open("t")
    assert t.scan().count() == 0
    t.load(tbl)
    t.load(tbl)
    t.add((9, 9.0, "z"))
    assert t.scan().count() == 7 and t.scan("(a = 3)").count() == 2 and t.close() == 1
    assert store.open("t").scan("(b > 1.0)").count() == 5
    assert store.drop("t") and not store.drop("t") and store.open("t") is None


def test_sorted(store, tbl, spark):
    with pytest.raises(ValueError):
        store.create("s", SCHEMA, "tree")
    with pytest.raises(ValueError):
        store.create("s", SCHEMA, "sorted")
    assert store.create("s", SCHEMA, "sorted", ["a", "c"], run_length=10)
    s = store.open("s")
    s.load(tbl)
    s.add((0, 1.0, "q"), (2, 7.0, "a"))
    assert s.meta["pending"]
    assert [r.a for r in s.scan().collect()] == [0, 1, 2, 2, 3]
    assert s.meta["pending"] is None
    before = s.scan()
    s.add((1, 0.0, "b"))
    s.scan()
    assert before.count() == 5  # a reader keeps the version that it has opened
    assert [(r.a, r.c) for r in store.open("s").scan("(a = 1)").collect()] == [(1, "b"), (1, "y")]
    assert s.key_prefix("(a = 1) AND (c = 'x')") == ["a", "c"] and s.key_prefix("(c = 'x')") == [] and s.key_prefix("(a = 1 OR a = 2)") == []
    assert "PushedFilters: [IsNotNull(a), EqualTo(a,1)]" in s.scan("(a = 1)")._jdf.queryExecution().executedPlan().toString()


def test_load_and_scan(store, tbl):
    assert store.load_and_scan("t", tbl, SCHEMA).count() == 3
    assert store.load_and_scan("t", tbl, SCHEMA, "(a > 1)").count() == 4


def test_small_files_are_replaced(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "f.json")
    for text in ("one", "two"):
        files.write(path, text)
        assert files.read(path) == text and not files.exists(path + ".new")


def test_catalog():
    text = "BEGIN\nregion\nregion.tbl\nr_regionkey Int\nr_name String\nEND\n\nBEGIN\nt\nt.tbl\nx Double\nEND\n"
    c = Catalog.parse(text)
    assert c.lookup("region").schema.names == ["r_regionkey", "r_name"] and Catalog.parse(c.text()).tables == c.tables
    assert c.drop("t") and not c.drop("t") and not c.add(c.lookup("region"))
    with pytest.raises(KeyError):
        c.lookup("t")
    for bad in ("BEGIN\nt\nt.tbl\nx Date\nEND", "region", text + text):
        with pytest.raises(ValueError):
            Catalog.parse(bad)
