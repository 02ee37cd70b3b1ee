import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm import common, minhash, queries, substrings, suffixes
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_components(rows, size, percent=80):
    """Component of each row by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [(doc_id, len(sets[i]), min(least[root(i)], default=None)) for i, (doc_id, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(edge, edge_texts, size):
    got = minhash.near_duplicates(edge, size=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(plain_components(edge_texts, size))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_of_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for group in range(6):
        words = [str(rng.randint(0, 10**6)) for _ in range(120)]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = str(rng.randint(0, 10**6))
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(plain_components(rows, 2))


def test_no_documents(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(50, 40), (40, 50), (7, 7)] + [(100, k) for k in range(101, 160)]
    found = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {k: 1 for k in range(1, 31)} | {40: 40, 50: 40} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(60):
        data = np.frombuffer(bytes(rng.choice(b"ab\xff" if trial % 2 else b"aab") for _ in range(rng.randint(1, 300))), np.uint8)
        b = data.tobytes()
        array, place = suffixes.suffix_array(data, 10**6)
        assert array.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = suffixes.common_prefixes(data, array, place, 200)
        for k in range(1, len(b)):
            x, y = b[array[k] :], b[array[k - 1] :]
            assert shared[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q or i == 200), min(len(x), len(y), 200))


def plain_repeats(texts, length=200):
    found = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in found for i in range(len(d) - length + 1))
    out = []
    for d in found:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [(512, 4 << 20), (2, 1500)])
def test_repeats(spark, edge_texts, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD_RUNS", shard[0])
    monkeypatch.setattr(substrings, "ARRAY_BYTES", shard[1])
    rng = random.Random(6)
    texts = list(edge_texts)
    passage = next(t for i, t in texts if i == 4)
    for k in range(30):
        a, b = sorted(rng.randrange(len(passage)) for _ in range(2))
        texts.append((100 + k, f"{k} " * rng.randint(0, 40) + passage[a:b] + f" {k * 7919}" * rng.randint(0, 9)))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, spans string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in substrings.without_repeats(df).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(texts, plain_repeats([t for _, t in texts])))


def test_no_repeats(nothing):
    assert substrings.without_repeats(nothing).count() == 0


def test_shared_folder(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("name", ["op5_repeated_bytes", "op6_near_duplicates", "op7_top_k"])
def test_queries_against_sql(name, spark, data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got, want = queries.QUERIES[name](spark, data).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_hot_groups(spark, monkeypatch):
    """Exact copies, near copies, texts alike by less than is asked for, and rows without doc_id, in groups that are larger than slots and cells."""
    monkeypatch.setattr(minhash, "SLOT", 8)
    monkeypatch.setattr(minhash, "CELL", 8)
    rng = random.Random(11)
    base = [str(rng.randint(0, 10**6)) for _ in range(150)]
    texts = [" ".join(base)] * 40
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.choice((2, 4, 8, 10, 14))):
            copy[rng.randrange(len(copy))] = str(rng.randint(0, 10**6))
        texts.append(" ".join(copy))
    rows = [(None if k % 17 == 3 else rng.randint(0, 10**9), t) for k, t in enumerate(texts)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(plain_components(rows, 2))


def test_links_of_rows_without_doc_id(spark):
    rng = random.Random(12)
    base = [str(rng.randint(0, 10**6)) for _ in range(200)]
    rows = [(i, " ".join([*base[:k], "x", *base[k + 1 :]])) for i, k in ((None, 50), (None, 100), (5, 150))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5).collect()
    assert {r.component_id for r in got} == {5}


def test_no_pattern_is_taken_for_a_copy(spark):
    a = [0]
    while len(a) < 4096:
        a += [1 - x for x in a]
    rows = [(1, "".join("ab"[x] for x in a)), (2, "".join("ba"[x] for x in a)), (3, " ".join("ab"[x] for x in a[:1024]) + " c"), (4, " ".join("ba"[x] for x in a[:1024]) + " d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, size=2).collect()) == Counter(plain_components(rows, 2))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in substrings.without_repeats(df).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, plain_repeats([t for _, t in rows])))
