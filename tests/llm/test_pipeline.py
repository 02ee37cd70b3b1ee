"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

from collections import Counter

from test_dedup import plain_components
from tokenizers import Tokenizer

import corpus_pipeline as p
from tessera.llm import bpe, common, subwords


def kept_bytes(texts, length=200):
    found = [t.encode() for t in texts]
    count = Counter(d[i : i + length] for d in found for i in range(len(d) - length + 1))
    out = []
    for d in found:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(d, gone) if not g))
    return out


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    columns = docs.columns
    start = {r.doc_id: r for r in docs.collect()}
    stages = dict(p.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "suffix_array_dedup", "mixing", "bpe"]

    clean, _ = common.written(stages["toxicity"](spark, docs, data), "t1")
    one = {r.doc_id: r for r in clean.collect()}
    labels = {r.doc_id: r.toxic for r in common.table(spark, data, "labels").collect()}
    assert clean.columns == columns and all(r == start[i] for i, r in one.items())
    assert sum(labels.get(i) == 0 for i in start) == sum(labels.get(i) == 0 for i in one)  # no clean document goes

    kept, _ = common.written(stages["near_dedup"](spark, clean, data), "t2")
    two = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and all(r == one[i] for i, r in two.items())
    assert set(two) == {c for _, _, c in plain_components([(i, r.text) for i, r in one.items()], 5)}

    cut, _ = common.written(stages["suffix_array_dedup"](spark, kept, data), "t3")
    three = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and set(three) == set(two)
    for (i, r), want in zip(two.items(), kept_bytes([r.text for r in two.values()])):
        assert three[i].text == want.decode("utf-8", "ignore") and three[i].n_chars == len(three[i].text) and three[i].source == r.source

    mixed, _ = common.written(stages["mixing"](spark, cut, data), "t4")
    rows = mixed.collect()
    assert mixed.columns == columns and {r.doc_id for r in rows} == set(three) and all(r == three[r.doc_id] for r in rows)

    library = Tokenizer.from_file(subwords.default_path())
    for r in stages["bpe"](spark, mixed, data).collect():
        assert list(r.ids) == library.encode(three[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_empty_table(spark, data, nothing):
    docs = nothing
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == nothing.columns
    assert docs.count() == 0


def test_edges(edge, edge_texts, spark, data):
    kept = p.remove_near_copies(spark, edge, data)
    want = {c for i, _, c in plain_components(edge_texts, 5) if i is not None}
    got = Counter(r.doc_id for r in kept.collect())
    assert set(got) - {None} == want and got[None] == 1 and got[5] == 1
    assert p.cut_repeats(spark, edge, data).count() == 16


def test_cut_keeps_replacement_characters(spark, data):
    passage = "".join(chr(0xE0 + k % 30) + str(k) for k in range(150))
    rows = [(1, "\ufffd one é" + passage + "è two \ufffd"), (2, "ü three" + passage + "four"), (3, None), (4, "\ufffd")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.cut_repeats(spark, docs, data).collect()}
    assert got == {1: ("\ufffd one éè two \ufffd", 14), 2: ("ü threefour", 11), 3: (None, 0), 4: ("\ufffd", 1)}
    assert p.without("aéb", [(2, 3)]) == "ab" and p.without("éaé", [(1, 4)]) == ""  # no character from the halves of two


def test_a_worker_keeps_what_one_operator_keeps():
    common.cache_of("bpe")["x"] = 1
    assert common.cache_of("bpe") == {"x": 1}
    assert common.cache_of("toxicity") == {} and list(common._caches) == ["toxicity"]
    path = subwords.default_path()
    assert bpe.model(path) is bpe.model(path) and path in common.cache_of("bpe")
    common.cache_of("minhash")
    assert path not in common.cache_of("bpe")
