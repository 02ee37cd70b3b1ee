import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, subwords, token_files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(subwords.default_path())


def test_trie_is_the_library(library):
    model = bpe.TrieBPE(subwords.default_path())
    rng = random.Random(3)
    letters = "ab \n\t\r'sdlT1²½é漢ñ\x1c\x85　!?😀́ x"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 600)])) for _ in range(30)) for _ in range(300)]
    texts += ["a" * 3000, "<|endoftext|>", " <|endoftext|>  x<|endoftext|>", "é" * 2000, "the" * 1000, "  \n\n x", ""]
    kept = subwords.Kept(model.encode_chunks, n=50)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in kept.encode(texts)]
    assert got == want
    assert [np.frombuffer(x, "<u4").tolist() for x in kept.encode(texts)] == want
    assert [model.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert model.decode([222, 50256, 10**6]) == "�<|endoftext|>"
    assert all("".join(c) == t for t, c in zip(texts, subwords.chunks_of(texts)))


def test_rows_of_chunks_are_the_library(library):
    rng = random.Random(5)
    letters = "ab \n\t\r'sdlT1\u00bd\u00e9\u6f22\u0120\u2581\x1c\x85\u3000!?\u0301x"
    chunks = [" " + "".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    chunks += [" <|endoftext|>", "<|endoftext|>", " x<|endoftext|>y", " ", "  ", "\nword", " word", " \u0120", " a\u0120b", " " + "a" * 3000] + [f" word{k}" for k in range(600)]
    calls = []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    encode = subwords.row_encoder(Counted())
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(chunks)] == [e.ids for e in library.encode_batch(chunks, add_special_tokens=False)]
    assert encode([]) == []
    calls.clear()
    encode([f" word{k}," for k in range(1000)])
    assert sum(calls) <= 4  # rows, not chunks


def test_encode_and_decode(edge, nothing, library):
    got = Counter((r.doc_id, tuple(r.ids), r.decoded, r.start) for r in bpe.decode(bpe.encode(edge)).collect())
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids), r.text or "", 7) for r in edge.collect())
    assert got == want
    assert bpe.decode(bpe.encode(nothing)).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(edge, spark, tmp_path, library, encoding):
    path = str(tmp_path / encoding)
    token_files.write(edge, path, encoding=encoding, page_rows=4)
    rows = token_files.with_crc32(token_files.read_with_start(spark, path)).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in edge.collect()), key=lambda i: (i is not None, i))
    at = 0
    want = Counter()
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    for r in edge.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    some = token_files.read(spark, path, 4, 6).select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,4)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan
    assert sorted(r.doc_id for r in some.collect()) == [4, 5, 5, 6]


def test_no_rows(nothing, spark, tmp_path):
    token_files.write(nothing, str(tmp_path / "none"))
    assert token_files.with_crc32(token_files.read_with_start(spark, str(tmp_path / "none"))).count() == 0
    with pytest.raises(ValueError):
        token_files.write(nothing, "unused", encoding="other")


def test_query_digests(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in bpe.op3_bpe(spark, data).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
