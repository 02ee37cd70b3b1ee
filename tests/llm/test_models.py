import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import attention, language, mixing, quality, subwords, textbytes, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=32)]) for k in range(150)]
    rows += [(200, None), (300, [1.0, None]), (400, [float("nan")] * 32), (500, [float("inf")] + [0.0] * 31), (None, rows[0][1]), (600, []), (7, rows[7][1]), (50, rows[50][1]), (601, [0.5, 0.25]), (700, [-1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(good) if b != a and len(w) == len(v))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:10])]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = np.floor(rng.normal(size=(40, 64)) * 1024), np.floor(rng.normal(size=(50, 64)) * 1024)
    for s in topk.LEVELS:
        assert (topk.statistics(a, s) @ topk.statistics(b, s).T + 1e-3 >= a @ b.T).all()


def test_language(spark, data, edge, nothing):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    found = language.op8_language(spark, data).join(docs, "doc_id").toPandas()
    assert ((found.lang == found.lang_pred) | ~found.held_out).mean() > 0.97 and found.score.between(0, 1).all()
    model = language.fit(edge)
    rows = language.predict(edge, model).collect()
    assert len(rows) == 16 and all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert language.fit(nothing) is None and language.predict(nothing, None).count() == 0
    assert {r.lang_pred for r in language.predict(edge, None).collect()} == {"und"}
    assert model.of_word("zzzzqqq").shape == (1,)


def plain_counts(t):
    w = WORD.findall(t)
    five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {i for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality(edge, nothing):
    rows = quality.judged(edge).collect()
    texts = Counter((r.doc_id, *plain_counts(r.text or "")) for r in edge.collect())
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in rows) == texts
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judged(nothing).count() == 0
    c = quality.base_counts(["a\n\nb\na\n \n ", "x|y #\r\n"])
    assert [tuple(int(c[k][i]) for k in quality.COUNTS) for i in (0, 1)] == [plain_counts("a\n\nb\na\n \n "), plain_counts("x|y #\r\n")]


def test_kneser_ney_sums_to_one():
    codes, _ = quality.ngram_codes(["the cat sat on the mat, and the dog too. " * 5, "another text with other words"])
    count = np.bincount(codes)
    table = quality.kneser_ney(np.flatnonzero(count), count[count > 0]).table().reshape(-1, quality.SYMBOLS)
    assert np.allclose((10.0 ** table[:: 997].astype(float)).sum(1), 1, atol=1e-4)


def test_noise_is_rejected(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = quality.op4_quality(spark, data).join(labels, "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.95 and found[found.quality == 0].kept.mean() < 0.7


def test_low_documents_that_pass_the_base_are_rejected(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = quality.op4_quality(spark, data).join(labels, "doc_id").filter("NOT base_failed").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.97 and found[found.quality == 0].kept.mean() < 0.3
    assert len(set(quality.symbol_table()[[ord(c) for c in "#$%&*|.,!?-"]])) == 11
    codes, _ = quality.ngram_codes(["the cat sat on the mat, and the dog too. " * 5, "### $$$ other"])
    count = np.bincount(codes)
    model = quality.kneser_ney(np.flatnonzero(count), count[count > 0])
    row, table = model.rows()
    some = np.concatenate([codes, np.random.default_rng(1).integers(0, quality.SYMBOLS**quality.ORDER, 2000)])
    assert np.allclose(model.table()[some], table[row[some // quality.SYMBOLS] * quality.SYMBOLS + some % quality.SYMBOLS], atol=1e-5)


def test_toxicity(spark, data, edge, nothing):
    data = data.replace("sf0.001", "sf0.01")  # the smallest table has too few toxic documents to learn from
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = toxicity.op10_toxicity(spark, data).join(labels, "doc_id").toPandas()
    assert (found.predicted == found.toxic)[found.held_out].mean() > 0.95 and found.score.between(0, 1).all()
    field = toxicity.fit(spark.read.parquet(f"{data}/documents.parquet"), labels)
    rows = toxicity.score(edge, field).collect()
    assert len(rows) == 16 and all(r.score < 0.5 and r.toxic_spans == [] for r in rows if not any(c.isalnum() for c in r.text or ""))
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    text = "Ä the İ of that MORON, pathetic and idiot the"
    (r,) = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).collect()
    assert r.score > 0.5 and any("MORON" in text[s.start - 1 : s.end + 1] for s in r.toxic_spans)
    assert toxicity.score(nothing, field).count() == 0
    assert toxicity.score(edge, toxicity.fit(nothing, labels)).filter("score >= 0.5").count() == 0


def test_marginals_are_forward_backward():
    rng = np.random.default_rng(3)
    f = toxicity.Field(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    e, first = rng.normal(size=300) * 3, np.zeros(300, bool)
    first[[0, 100, 101, 250]] = True
    want = []
    for part in np.split(e, [100, 101, 250]):
        em, a = np.stack([np.ones(len(part)), np.exp(part)], 1), np.exp(f.step)
        al, be = [np.exp(f.start) * em[0]], [np.ones(2)]
        for t in range(1, len(part)):
            x = (al[-1] @ a) * em[t]
            al.append(x / x.sum())
        for t in range(len(part) - 1, 0, -1):
            x = a @ (em[t] * be[0])
            be.insert(0, x / x.sum())
        g = np.array(al) * np.array(be)
        want.append(g[:, 1] / g.sum(1))
    assert np.allclose(f.marginals(e, first), np.concatenate(want))


def test_lm_score(edge, nothing):
    training = F.coalesce(F.col("doc_id"), F.lit(-1)) % 2 == 0
    rows = attention.score(edge, training).collect()
    low = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c < "\x80" else c for c in w) for w in WORD.findall(t or "")]
    every = edge.collect()
    train = [r for r in every if r.doc_id is not None and r.doc_id % 2 == 0]
    c = Counter(w for r in train for w in low(r.text))
    n, v = sum(c.values()) + len(train), len(c) + 1
    p = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter((r.doc_id, len(low(r.text)) + 1, sum(c[w] > 0 for w in low(r.text)) + 1, n, round(sum(p(c[w]) for w in low(r.text)) + p(len(train)), 4)) for r in every)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert attention.score(nothing, training).count() == 0
    assert {r.train_tokens for r in attention.score(edge.limit(2), F.lit(False)).collect()} == {0}


def test_lm_learns_from_all_training_rows(spark):
    path, rng = subwords.default_path(), np.random.default_rng(6)
    texts = [" ".join(rng.choice(["red", "green", "blue", "stone", "river", "cloud"], 30)) for _ in range(60)] + ["zebra quartz"] * 3 + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = attention.word_counts(df)
    model, by_class = attention.fit(df, counts, len(texts), path, sample=0)  # the start has no text at all
    begins = attention.beginning(path)
    id_counts, _ = attention.subword_counts(counts, path, len(begins))
    id_counts[-1] += len(texts)
    stream, sizes = attention.segment_stream([t or "" for t in texts], path, len(begins) - 1)
    assert set(stream.tolist()) <= set(np.flatnonzero(id_counts).tolist())
    plain: Counter = Counter()
    column = attention.column_of(id_counts)
    for x in np.split(stream, np.cumsum(sizes)[:-1]):
        for i, j in zip(x.tolist(), x.tolist()[1:]):
            plain[i * 2 * attention.COLUMNS + int(column[j])] += 1
            plain[j * 2 * attention.COLUMNS + attention.COLUMNS + int(column[i])] += 1
    assert dict(zip(*(x.tolist() for x in attention.neighbours_of(df, id_counts, path)))) == plain
    words = Counter(w for t in texts for w in (t or "").split())
    first = {w: attention.encoded_words([w.encode()], path)[0] for w in words}
    totals = np.bincount([model.class_of[int.from_bytes(first[w][:4], "little")] for w in words], list(words.values()), attention.CLASSES)
    assert np.array_equal(by_class, totals)
    fresh = attention.untrained(model.features, model.class_of, id_counts, np.random.default_rng(1))
    at, real = attention.windows_of_segments(sizes)
    loss = lambda m: -np.log(np.take_along_axis(softmax(m.attend(stream[at])[0] @ m.out + m.bias), m.class_of[stream[at + 1]][:, :, None], 2)[:, :, 0][real]).mean()
    assert loss(model) < loss(fresh)


def test_all_ids_of_all_training_texts_are_looked_at(spark):
    path = subwords.default_path()
    end = len(attention.beginning(path)) - 1
    rng = np.random.default_rng(4)
    texts = [" ".join(str(x) for x in rng.integers(0, 9999, n)) for n in (0, 1, 12, 13, 100, 1000)]
    whole = [[end, *(i for p in attention.encoded_words(attention.words_of(t), path) for i in np.frombuffer(p, "<u4").tolist()), end] for t in texts]
    stream, sizes = attention.segment_stream(texts, path, end)
    assert [x.tolist() for x in np.split(stream, np.cumsum(sizes)[:-1])] == whole
    at, real = attention.windows_of_segments(sizes)
    starts = np.cumsum(sizes) - sizes
    assert sorted((at + 1)[real].tolist()) == sorted(set(range(len(stream))) - set(starts.tolist()))  # each is predicted once
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = attention.untrained(rng.normal(size=(end + 1, attention.FEATURES)).astype(np.float32), rng.integers(0, attention.CLASSES, end + 1), np.ones(end + 1), rng)
    assert attention.summed_gradients(model, attention.streams(df, path, end))[1] == sum(len(x) - 1 for x in whole)


def test_lm_texts_are_read_twice_at_most(spark):
    texts = [f"red green stone {'blue ' * (k % 7)}" for k in range(40)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, plain string").repartition(3).select("doc_id", told.asNondeterministic()("plain").alias("text"))
    assert attention.score(df, F.col("doc_id") % 2 == 0).count() == 40
    assert 40 <= read.value <= 80  # once for ids and counts, once for the texts that the weights start from


def test_lm_counts_come_from_written_ids(spark, monkeypatch):
    path = subwords.default_path()
    begins = attention.beginning(path)
    end = len(begins) - 1
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(["red", "gReen", "blue,", "thorbleandhe", "é", "漢字😀", "stone\tone"], n)) for n in (0, 1, 5, 40, 300, 2000)] + [None]
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "doc_id long, text string, training boolean").repartition(3)
    rows = attention.encoded(df, path, end).cache()
    in_text = [attention.words_of(t or "") for t in texts]
    key = {w: attention.word_hashes(np.array([end, *np.frombuffer(attention.encoded_words([w], path)[0], "<u4"), end], np.int64), begins)[0].item() for t in in_text for w in t}
    assert len(set(key.values())) == len(key)
    trained = Counter(w for t in in_text[::2] for w in t)
    for batch in rows.filter(F.col("step") <= attention.STEPS).collect():
        stream, sizes = next(attention.read_streams([pa.RecordBatch.from_pydict({"ids": [bytes(batch.ids)], "sizes": [bytes(batch.sizes)]})], end))
        for i, x in zip(batch.docs, np.split(stream, np.cumsum(sizes)[:-1])):
            assert attention.word_hashes(x, begins)[0].tolist() == [key[w] for w in in_text[i]] and (batch.step == attention.STEPS) == (i % 2 == 1)
    ids = Counter(i for t in in_text[::2] for w in t for i in np.frombuffer(attention.encoded_words([w], path)[0], "<u4").tolist()) + Counter({end: 4})
    total, first = attention.added_ids(rows.filter(F.col("step") == attention.STEPS + 2), end + 1)
    assert {i: c for i, c in enumerate(total.tolist()) if c} == ids and first.sum() == trained.total() + 4
    monkeypatch.setattr(attention, "HASHES_AT_ONCE", 3)
    known = attention.block_counts(rows.filter(F.col("step") == attention.STEPS + 1)).collect()
    assert sum(r.many for r in known) == len(trained)
    of: dict = {}
    for r in known:
        if r.block >= 0:
            of.setdefault(r.block, {}).update(zip(np.frombuffer(r.h, np.uint64).tolist(), np.frombuffer(r.n, np.int64).tolist()))
    want = {key[w]: c for w, c in trained.items()}
    assert set().union(*of.values()) == set(want) and all(want[h] == c for x in of.values() for h, c in x.items())


def test_lm_words_with_equal_ids_are_told_apart(spark, tmp_path):
    with open(subwords.default_path(), encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = {"type": "NFC"}
    path = tmp_path / "nfc.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    df = spark.createDataFrame([(0, "\u00e9 \u00e9 \u00e9 x"), (1, "e\u0301 x")], "doc_id long, text string")
    one, two = sorted(attention.score(df, F.col("doc_id") == 0, str(path)).collect())
    assert (one.n_known, two.n_known, one.n_tokens, two.n_tokens) == (5, 2, 5, 3)
    assert np.isclose(two.base_score, math.log10(0.1 / 5.4) + 2 * math.log10(1.1 / 5.4))  # N 5, V 3


def test_segments_leave_no_text_out():
    rng = np.random.default_rng(3)
    for n in (0, 1, 12, 13, 100, 1000):
        text = " ".join(str(x) for x in rng.integers(0, 9999, n))
        found = attention.segments([text])
        assert found and all(w in text.encode().split() for s, _, _ in found for w in s)
        assert len(found) >= max(1, -(-n // attention.SEGMENT) // attention.EVERY)
    every = attention.segments([text], every=1)
    assert [w for s, _, _ in every for w in s] == text.encode().split() and every[0][1] and every[-1][2]


def test_chances_of_words_add_up_to_one_at_most():
    path = subwords.default_path()
    begins = attention.beginning(path)
    rng = np.random.default_rng(2)
    features = rng.normal(size=(len(begins), attention.FEATURES)).astype(np.float32)
    counts = rng.integers(0, 50, len(begins))
    m = attention.untrained(features, attention.classes(features, begins, counts, rng), counts, rng)
    end = len(begins) - 1
    assert set(m.class_of[begins]) == set(range(attention.STARTS)) and m.class_of[end] == 0 and (m.class_of[~begins] >= attention.STARTS).all()
    before = np.array([end, *np.frombuffer(b"".join(attention.word_ids(path).fill([b"one", b"word"])), "<u4")], np.int64)
    # every id may come next; those that begin a word, and the end, add up to the chance that one begins
    state = m.attend(before[None])[0][0, -1] @ m.out + m.bias
    p = softmax(state)[m.class_of] * 10.0 ** m.within.astype(float)
    logs, starts = m.log10_ids(np.array([*before, end]))
    assert np.isclose(p.sum(), 1, atol=1e-3) and np.isclose(p[begins].sum(), 10.0 ** starts[-1], rtol=1e-3) and np.isclose(p[end], 10.0 ** logs[-1], rtol=1e-3)
    # words of one id, spelled to their end, and the end of the text
    total = 0.0
    for i in np.flatnonzero(begins[:-1])[:300]:
        ids = np.array([*before, i, end])
        logs, starts = m.log10_ids(ids)
        spelled, kind_log, kind = attention.token_logs(ids[1:], logs[1:], starts[1:], m)
        assert np.isclose(spelled[-2], logs[-2] - starts[-2] + starts[-1], atol=1e-5) and kind[-1] == 0 and kind_log[-2] <= 1e-6
        total += 10.0 ** spelled[-2]
    assert total < 1


def test_words_in_a_row_are_encoded_as_alone():
    path = subwords.default_path()
    words = [w.encode("utf-8") for w in "the of don't x\u00a0 \u00a0y é漢字😀 <|endoftext|> 12³ ... a\u2028 \x1cb \ufffd thorbleandhe,### a".split(" ")] + [b"\xff\xc3(", b"x" * 3000]
    alone = [attention.encoded_words([w], path)[0] for w in words]
    assert attention.encoded_words(words, path) == alone
    plain = [w for w in words if not attention._ODD.search(w.decode("utf-8", "replace"))]
    library = attention.tokenizer_of(path)
    assert attention.encoded_words(plain * 100, path) == [np.array(library.encode(" " + w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for w in plain] * 100


def test_texts_are_joined_word_by_word():
    parts = [np.array(x, "<u4").tobytes() for x in ([5], [6, 7], [8, 9, 10])]
    stream, sizes = attention.joined(parts, np.array([2, 0, 1, 1]), np.array([0, 2, 0, 2]), 99)
    assert stream.tolist() == [99, 99, 8, 9, 10, 5, 99, 99, 6, 7, 6, 7, 99] and sizes.tolist() == [1, 5, 1, 5]
    stream, sizes = attention.joined([], np.zeros(0, np.int64), np.array([0]), 99)
    assert stream.tolist() == [99, 99] and sizes.tolist() == [1]


def test_states_are_those_of_training():
    rng = np.random.default_rng(4)
    m, ids = small_model(rng), rng.integers(0, 61, (9, attention.WINDOW))
    x = m.features[ids] @ m.embed + m.place
    got = m.states(x, (m.q @ m.k.T) * np.float32(attention.WIDTH**-0.5), m.v @ m.o, np.tri(attention.WINDOW, dtype=np.float32))
    assert np.allclose(got, m.attend(ids)[0], atol=1e-4)


def test_met_before():
    words = np.array([5, 5, 7, 5, 5, 7], np.uint64)
    assert np.allclose(attention.met_before(words, np.array([4, 0, 2])), [0, 1, 0, 2 / 3, 0, 0])


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def test_lm_scores_do_not_depend_on_other_texts(spark, edge):
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 7, 15, 16, 17, 31, 40, 100, 5)]
    model, end = small_model(rng), 60
    whole = np.concatenate([[end], *([*t, end] for t in texts)]).astype(np.int64)
    attention.train(model, [whole], epochs=1)
    (logs, starts), at = model.log10_ids(whole, np.array([len(t) + 1 for t in texts])), 1
    for t in texts:
        alone, begin = model.log10_ids(np.array([end, *t, end]))
        assert (alone[1:] < 0).all() and np.allclose(logs[at : at + len(t) + 1], alone[1:], atol=1e-5) and np.allclose(starts[at : at + len(t) + 1], begin[1:], atol=1e-5)
        at += len(t) + 1
    training = F.coalesce(F.col("doc_id"), F.lit(-1)) % 2 == 0
    docs = edge.unionAll(edge.filter("doc_id < 8")).select("doc_id", "text").cache()
    plain = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in attention.score(df, training).collect())
    one = plain(docs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    two = plain(docs.repartition(7, "text"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[:3] for r in one] == [r[:3] for r in two] and np.allclose([r[3] for r in one], [r[3] for r in two], rtol=1e-4)
    of: dict = {}
    for r in one:
        of.setdefault(r[:3], []).append(r[3])
    assert sum(len(s) > 1 for s in of.values()) >= 6 and all(np.allclose(s, s[0], rtol=1e-6) for s in of.values())


def small_model(rng):
    begins = np.arange(61) % 3 == 0
    begins[-1] = True
    features = rng.normal(0, 0.2, (61, attention.FEATURES)).astype(np.float32)
    counts = rng.integers(0, 9, 61)
    return attention.untrained(features, attention.classes(features, begins, counts, rng), counts, rng)


def test_gradients_are_differences():
    rng = np.random.default_rng(8)
    ids, real = rng.integers(0, 40, (3, attention.WINDOW)), rng.random((3, attention.WINDOW)) < 0.7
    m = small_model(rng)
    for name in (*attention.WEIGHTS, "features"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    y = m.class_of[rng.integers(0, 40, ids.shape)]
    loss = lambda: -np.log(np.take_along_axis(softmax(m.attend(ids)[0] @ m.out + m.bias), y[:, :, None], 2)[:, :, 0])[real].sum()
    for name, grad in attention.gradients(m, ids, y, real).items():
        w = getattr(m, name)
        w[0] += 1e-5
        up = loss()
        w[0] -= 2e-5
        assert np.isclose((up - loss()) / 2e-5, grad[0].sum(), atol=1e-3), name
        w[0] += 1e-5


def test_attention_is_causal():
    rng = np.random.default_rng(5)
    model, end = small_model(rng), 60
    ids = np.concatenate([[end], rng.integers(0, 50, 200)])
    attention.train(model, [ids], epochs=1)
    logs, starts = model.log10_ids(ids)
    assert logs[0] == 0 and (logs[1:] < 0).all() and (starts <= 1e-6).all()
    other = ids.copy()
    other[150:] = 3
    found = model.log10_ids(other)
    assert np.allclose(found[0][1:150], logs[1:150], atol=1e-5) and np.allclose(found[1][1:151], starts[1:151], atol=1e-5)
    total = sum(10.0 ** float(model.log10_ids(np.array([*ids[:20], k]))[0][20]) for k in range(61))
    assert np.isclose(total, 1, atol=1e-3)


def test_mixing(spark, data, edge, nothing):
    found = mixing.op1_mixing(spark, data).toPandas()
    tokens = (found[["p_clean", "p_low", "p_toxic"]].mul(found.n_tokens * found.rate, axis=0)).sum() / found.n_tokens.sum()
    assert np.allclose(tokens, list(mixing.TARGETS.values()), atol=0.01) and (found.rate >= 0).all()
    labels = spark.createDataFrame([(0, "a"), (4, "b"), (5, "b"), (None, "a"), (8, None), (9, "other")], "doc_id long, domain string")
    rows = mixing.mix(edge, labels, {"a": 1.0, "b": 1.0}, least=1.0).collect()
    assert len(rows) == 16 and all(r.rate >= 1 and np.isclose(sum(r.posterior), 1) for r in rows)
    assert mixing.mix(nothing, labels, {"a": 0.5, "b": 0.5}).count() == 0
    assert len(mixing.mix(edge, labels.limit(0), {"a": 0.9, "b": 0.1}).collect()) == 16


def test_projected_steps_reach_least_squares(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    n = rng.integers(1, 500, 300)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    goal = np.array([0.7, 0.25, 0.05])
    r = np.array([x.rate for x in mixing.with_rates(df, mixing.solve(df, goal)).collect()])
    assert (r >= 0).all() and np.allclose((n * r) @ p / n.sum(), goal, atol=2e-3)
    for least in (0.0, 1.0):
        r = np.array([x.rate for x in mixing.with_rates(df, mixing.solve(df, goal, least, budget=float(n.sum())), least).collect()])
        assert np.allclose(r, nonnegative_least_squares(p, n, goal, least), atol=1e-4)


def nonnegative_least_squares(p, n, goal, least):
    """Direct: the weighted squares as rows of one matrix; variables enter and leave the free set one by one."""
    share = n / n.sum()
    a = np.vstack([p.T * share, np.diag(np.sqrt(mixing.PULL * share))])
    b = np.concatenate([goal, np.sqrt(mixing.PULL * share)]) - a @ np.full(len(n), least)
    free, x = np.zeros(len(n), bool), np.zeros(len(n))
    while True:
        g = a.T @ (b - a @ x)
        if not (~free & (g > 1e-12)).any():
            return x + least
        free[np.where(free, -np.inf, g).argmax()] = True
        while True:
            z = np.zeros(len(n))
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] >= 0).all():
                x = z
                break
            back = free & (z < 0)
            x = x + (x[back] / (x[back] - z[back])).min() * (z - x)
            free &= x > 1e-14


def test_mixing_says_when_it_ends_too_early(spark, monkeypatch):
    df = spark.createDataFrame([(5, [0.9, 0.1]), (7, [0.2, 0.8])], "n_tokens long, posterior array<double>")
    monkeypatch.setattr(mixing, "PASSES", 1)
    with pytest.raises(RuntimeError):
        mixing.solve(df, np.array([0.99, 0.01]))


def test_odd_column_names(spark, edge, data):
    import corpus_pipeline

    df = edge.select("*", F.lit(1).alias("meta-data"), F.lit("x").alias("a`b c"), F.lit(2.0).alias("rate"))
    for stage in (corpus_pipeline.remove_toxic, corpus_pipeline.cut_repeats, corpus_pipeline.mix_sources):
        got = stage(spark, df, data)
        assert got.columns == df.columns and {r["meta-data"] for r in got.collect()} == {1}
    found = mixing.with_rates(spark.createDataFrame([(5, [0.9, 0.1], "x")], "n_tokens long, posterior array<double>, rate string"), np.zeros(2))
    assert found.columns == ["n_tokens", "posterior", "rate"] and found.first().rate == 1


def thue_morse(n):
    a = [0]
    while len(a) < n:
        a += [1 - x for x in a]
    return "".join("ab"[x] for x in a), "".join("ba"[x] for x in a)


def test_no_pattern_makes_hashes_equal():
    for n in (64, 1024, 2048, 4096, 8192):
        x, y = thue_morse(n)
        t = textbytes.Texts([x, y, x + " " + y, " ".join(x), " ".join(y)])
        start, end, _ = t.words()
        h = textbytes.span_hashes(t.data, start, end)
        assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
        a, b = (textbytes.windows(h[k : k + n], np.array([n]), n)[0][0] for k in (4, 4 + n))
        assert a != b


def test_word_hashes():
    t = textbytes.Texts(["a bb A", "", " bb\x0b", "a"], lower=True)
    start, end, counts = t.words()
    h = textbytes.span_hashes(t.data, start, end)
    assert counts.tolist() == [3, 0, 1, 1] and h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 2


