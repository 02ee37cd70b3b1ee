import json
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import subwords, token_files


def test_chunks_before_marks_are_the_library():
    path = subwords.default_path()
    library, rng = Tokenizer.from_file(path), random.Random(7)
    letters = "ab z\n\t,.;:!?#$%&*+=\"'sdlT1²½éÃ×÷ÀÿĀ漢ñ\x1c\x85 　 …—’\U0001f600́ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["x<|endoftext|>,y", "a<|endoftext|>", "don't, we'll.", "<|endo,ftext|>", " ,", "", ",", "\n", "é", "漢 "]
    kept = subwords.Kept(subwords.row_encoder(library), n=100, marks=subwords.marks_of(path))
    assert kept.marks == subwords.MARKS
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, at = kept.encode_all(pa.array([*texts, None])[1:])  # a slice, and a null
        assert [x.tolist() for x in np.split(ids, at[1:-1])] == [*want[1:], []]
    assert [x.tolist() for x in kept.encode_all([])] == [[], [0]]


def test_a_word_is_encoded_once_whatever_mark_follows():
    asked = []
    kept = subwords.Kept(lambda chunks: asked.append(chunks) or [b"\1\0\0\0"] * len(chunks), marks=subwords.MARKS)
    kept.encode(["one word, one word. " * 50 + "word"])
    kept.encode(["one word word; one"])
    assert sorted(asked[0]) == sorted(["one", " one", " word", ",", "."])
    assert asked[1:] == [[";"]]


def test_marks_of_other_tokenizers(tmp_path):
    with open(subwords.default_path(), encoding="utf-8") as f:
        told = json.load(f)
    told["model"]["vocab"], told["model"]["merges"] = {}, []
    (tmp_path / "added").write_text(json.dumps(told | {"added_tokens": [{"content": "e.g."}]}))
    (tmp_path / "other").write_text(json.dumps(told | {"pre_tokenizer": {"type": "Metaspace"}}))
    assert "." not in subwords.marks_of(str(tmp_path / "added")) and "," in subwords.marks_of(str(tmp_path / "added"))
    assert subwords.marks_of(str(tmp_path / "other")) == ""


def test_runs_hold_all_rows():
    texts = ["a" * n for n in (0, 5, 30, 1, 1, 1, 100, 0, 2)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string())], names=["text"]) for a, b in ((0, 4), (4, 4), (4, 10))]
    got = [b.column("text").to_pylist() for b in token_files.runs(iter(batches), at_once=10)]
    assert [t for run in got for t in run] == texts and [len(run) for run in got] == [3, 4, 3]
