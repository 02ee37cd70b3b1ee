"""Byte-level BPE by a prefix-sharing trie.

The last token of the encoding of a prefix, together with the encodings of shorter prefixes, fixes the whole encoding: a sequence of
tokens is what BPE gives if and only if it is so for each two neighbours. So distinct words go into a trie, and a depth-first walk carries the last
token from each prefix to the next: of the tokens that end at a new byte, just one agrees with the last token before it. A prefix that
words share is worked out once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, subwords
from tessera.llm.token_files import runs

#: The split of the byte-level pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is visible Latin-1, else the next from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    found = {chr(b): b for b in visible}
    hidden = (b for b in range(256) if chr(b) not in found)
    return found | {chr(256 + k): b for k, b in enumerate(hidden)}


class TrieBPE:
    """Encodes words and decodes ids as the tokenizer file (byte-level BPE of the tokenizers library) says."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        if told["model"]["type"] != "BPE" or (told["pre_tokenizer"] or {}).get("type") != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"] or told["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        to_byte = byte_characters()
        vocabulary = told["model"]["vocab"]
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocabulary.items() if all(c in to_byte for c in token)}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words_of = regex.compile(WORDS).findall
        self.rank: dict[tuple[int, int], int] = {}  # of a merge, by its two tokens
        self.halves: dict[int, tuple[int, int, int]] = {}  # of a token: left, right, rank of their merge
        for rank, merge in enumerate(told["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = vocabulary[left], vocabulary[right]
            self.rank[a, b] = rank
            self.halves.setdefault(vocabulary[left + right], (a, b, rank))
        special = set(self.special.values())
        self.ends: dict[bytes, int] = {}  # each end of a token -> the token that it is, or -1
        for i, token in self.bytes_of.items():
            if i not in special:
                for k in range(1, len(token)):
                    self.ends.setdefault(token[k:], -1)
        for i, token in self.bytes_of.items():
            if i not in special and (len(token) == 1 or i in self.halves):
                self.ends[token] = i
        self.agree: dict[int, bool] = {}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b gives a, b: no merge across the border comes before the merges that take its two sides away."""
        key = a << 32 | b
        if (known := self.agree.get(key)) is not None:
            return known
        right_edge, gone = [], 1 << 40
        while True:
            right_edge.append((a, gone))
            if a not in self.halves:
                break
            _, a, gone = self.halves[a]
        ok, gone = True, 1 << 40
        while ok:
            for u, u_gone in right_edge:
                rank = self.rank.get((u, b))
                if rank is not None and rank < u_gone and rank <= gone:  # of equal merges the left one comes first
                    ok = False
                    break
            if b not in self.halves:
                break
            b, _, gone = self.halves[b]
        if len(self.agree) > 2_000_000:
            self.agree.clear()
        self.agree[key] = ok
        return ok

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """ids of each distinct word. The sorted words are a depth-first walk of their trie; the stack holds the states of the prefix in common."""
        found: dict[str, list[int]] = {}
        last: list[int] = [-1]  # by depth: the last token of the encoding of the prefix
        back: list[int] = [0]  # by depth: where that token begins
        before = b""
        ends, neighbours = self.ends, self.neighbours
        for data, word in sorted((w.encode(), w) for w in set(words)):
            shared, most = 0, min(len(data), len(before))
            while shared < most and data[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            for depth in range(shared + 1, len(data) + 1):
                tokens = []
                for start in range(depth - 1, -1, -1):
                    token = ends.get(data[start:depth])
                    if token is None:
                        break
                    if token >= 0:
                        tokens.append((start, token))
                for start, token in reversed(tokens):
                    if start == 0 or neighbours(last[start], token):
                        last.append(token)
                        back.append(start)
                        break
                else:
                    raise ValueError("a byte is missing from the vocabulary")
            before, ids, depth = data, [], len(data)
            while depth:
                ids.append(last[depth])
                depth = back[depth]
            found[word] = ids[::-1]
        return found

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """ids of each chunk as little-endian 32-bit bytes; special tokens are cut out first."""
        split = []
        for chunk in chunks:
            found = []
            for k, piece in enumerate(self.split_special.split(chunk) if self.split_special else [chunk]):
                found += [self.special[piece]] if k % 2 else self.words_of(piece)
            split.append(found)
        ids_of = self.encode_words(w for found in split for w in found if isinstance(w, str))
        return [np.array([i for w in found for i in ([w] if isinstance(w, int) else ids_of[w])], "<u4").tobytes() for found in split]

    def decode(self, ids: Iterable[int]) -> str:
        """As decode(ids, skip_special_tokens=False): unknown ids give nothing, bytes that are not UTF-8 the replacement character."""
        table, n = self.table, len(self.table)
        try:
            data = b"".join(map(table.__getitem__, ids))
        except IndexError:
            data = b"".join(table[i] for i in ids if i < n)
        return data.decode("utf-8", "replace")


def model(path: str) -> tuple[TrieBPE, subwords.Kept]:
    """Of this Python worker."""
    models = common.cache_of("bpe")
    if path not in models:
        bpe = TrieBPE(path)
        models[path] = bpe, subwords.Kept(bpe.encode_chunks, marks=subwords.marks_of(path))
    return models[path]


def encode(df: DataFrame, tokenizer: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>) for its text column; other columns stay.

    A null or empty text has no ids. Rows are independent: repeated rows have the same ids, an empty table stays empty, and texts
    are taken whole, however long. A column of df that is named as the new one is replaced.
    """
    path = tokenizer or subwords.default_path()
    df = df.drop(ids)
    common.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = model(path)[1].encode_all
        for rows in runs(batches, text):
            found, at = encode_all(rows.column(text))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.view("<i4")))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, ids])

    return df.mapInArrow(run, common.schema_with(df, f"`{ids}` array<int>"))


def decode(df: DataFrame, tokenizer: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a column of the text that its ids stand for. Null ids give an empty text; a column of that name is replaced."""
    path = tokenizer or subwords.default_path()
    df = df.drop(text)
    common.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)[0]
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([bpe.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in rows.column(ids)], pa.string())], names=[*rows.schema.names, text])

    return df.mapInArrow(run, common.schema_with(df, f"`{text}` string"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(common.documents(spark, sf_dir)).select("doc_id", "ids"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
