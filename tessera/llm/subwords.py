"""Texts as chunks that a byte-level BPE tokenizer treats independently, with a bounded cache of their encodings."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: The default tokenizer file, by its name in the folder of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"

#: Longer chunks are encoded each time they come, so that the cache has a bound in bytes.
LONGEST_KEPT = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: By UTF-8 byte: 1 for one that ends a visible ASCII character, 2 for one that ends a longer character.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 1
_KIND[0x80:] = 2


#: Marks before which a run of letters ends in a byte-level pre-tokenizer, whatever comes next.
MARKS = ",.;:!?#$%&*+=\""

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def marks_of(path: str) -> str:
    """Those of MARKS before which chunks may be cut for a tokenizer file: none, unless its pre-tokenizer is the byte-level one; and none that its added tokens hold."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    if told.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True):
        return ""
    return "".join(c for c in MARKS if not any(c in x["content"] for x in told.get("added_tokens") or ()))


def utf8_of(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, with the end of the last. A null is an empty text."""
    if isinstance(texts, pa.Array):
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        return data[ends[0] : ends[-1]], ends - ends[0]
    encoded = [t.encode("utf-8") for t in texts]
    return np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])


def chunk_starts(data: np.ndarray, texts: np.ndarray, marks: str = "") -> np.ndarray:
    """Where chunks of texts begin, given what utf8_of gives.

    Besides its start, a text is cut only between a character that no regex engine takes for white space and a space or line end that follows it, and between a letter
    of ASCII or Latin-1 and one of marks. The tokenizer's own pattern always has a boundary there, and nothing to the left depends on what follows. Where a character may
    be white space in some engine there is no cut.
    """
    begins = np.zeros(len(data) + 1, bool)
    padded = np.concatenate([np.zeros(3, np.uint8), data])  # a text may be shorter than what is looked at
    space = np.flatnonzero((data == 0x20) | (data == 0x0A))
    kind = _KIND[padded[space + 2]]
    wide = np.flatnonzero(kind == 2)
    if len(wide):
        a, b, c = (padded[space[wide] + k] for k in range(3))  # the three bytes before the space
        white = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)
        kind[wide[white]] = 0
    begins[space[kind > 0]] = True
    if marks:
        is_mark = np.zeros(256, bool)
        is_mark[list(marks.encode())] = True
        mark = np.flatnonzero(is_mark[data])
        b, c = padded[mark + 1], padded[mark + 2]  # the two bytes before the mark
        begins[mark[_LETTER[c] | (b == 0xC3) & (c >= 0x80) & (c != 0x97) & (c != 0xB7)]] = True
    begins[texts] = True  # of empty texts too, where the next one begins
    begins[-1] = False
    return np.flatnonzero(begins)


def chunks_of(texts: list[str]) -> list[list[str]]:
    """The chunks of each text."""
    data, ends = utf8_of(texts)
    start = chunk_starts(data, ends)
    chunks = [data[a:b].tobytes().decode("utf-8") for a, b in zip(start, np.append(start[1:], len(data)))]
    at = np.searchsorted(start, ends)
    return [chunks[a:b] for a, b in zip(at[:-1], at[1:])]


#: Chunks that are encoded in one row.
ROW = 256


def row_encoder(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """A function that gives the ids of each chunk as little-endian 32-bit bytes.

    Chunks that begin with a space and have no other white space are encoded in rows, which are cut at the ids that begin with a space. Other chunks, and those of a
    row that has more or fewer of such ids, are encoded one by one.
    """
    vocabulary = tokenizer.get_vocab()
    begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    begins[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True
    if any(t.lstrip or t.content[:1] == "\u0120" for t in tokenizer.get_added_tokens_decoder().values()):
        begins[:] = False  # spaces may be theirs

    def encode(chunks: list[str]) -> list[bytes]:
        out = [b""] * len(chunks)
        plain, single = [], []
        for k, chunk in enumerate(chunks):
            (plain if chunk[:1] == " " and chunk.split() == [chunk[1:]] else single).append(k)
        rows = [plain[s : s + ROW] for s in range(0, len(plain), ROW)]
        for row, e in zip(rows, tokenizer.encode_batch_fast(["".join([chunks[k] for k in row]) for row in rows], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(begins[ids])
            if len(at) == len(row) and at[0] == 0:
                data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                for k, a, b in zip(row, ends, ends[1:]):
                    out[k] = data[a:b]
            else:
                single += row
        for k, e in zip(single, tokenizer.encode_batch_fast([chunks[k] for k in single], add_special_tokens=False)):
            out[k] = struct.pack(f"<{len(ids := e.ids)}I", *ids)
        return out

    return encode


def taken(parts: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of parts[i] for each i of index, one after the other, and where each begins, with the end of the last."""
    flat = np.frombuffer(b"".join(parts), "<u4")
    size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    n = size[index]
    at = np.zeros(len(index) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    where = np.repeat((np.cumsum(size) - size)[index] - at[:-1], n)
    where += np.arange(len(where))
    return flat[where], at


class Kept(dict):
    """chunk (bytes) -> encoding for the chunks in use lately: two generations, the younger of at most n entries besides those of one call. fill takes chunks as strings, raw ones as bytes."""

    def __init__(self, fill: Callable[[list[str]], Iterable[bytes]], n: int = 300_000, marks: str = "", raw: bool = False):
        super().__init__()
        self.fill, self.n, self.marks, self.raw = fill, n, marks, raw
        self.old: dict[bytes, bytes] = {}

    def parts(self, chunks: list[bytes]) -> list[bytes]:
        """The encoding of each of distinct chunks."""
        parts = list(map(self.get, chunks))
        unknown = [k for k, v in enumerate(parts) if v is None]
        for k, v in zip(unknown, map(self.old.get, [chunks[k] for k in unknown])):
            parts[k] = v
        again = [k for k in unknown if parts[k] is not None]
        self.update((chunks[k], parts[k]) for k in again)
        missing = [k for k in unknown if parts[k] is None] if len(again) < len(unknown) else []
        for k, v in zip(missing, self.fill([chunks[k] if self.raw else chunks[k].decode("utf-8") for k in missing]) if missing else ()):
            parts[k] = v
        self.update((chunks[k], parts[k]) for k in missing if len(chunks[k]) <= LONGEST_KEPT)
        if len(self) > self.n:
            self.old = dict(self)
            self.clear()
        return parts

    def encode_all(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each begin, with the end of the last. Each distinct chunk of the call is looked up once."""
        return self.encode_spans(*utf8_of(texts))

    def encode_spans(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode_all, of what utf8_of gives."""
        start = chunk_starts(data, ends, self.marks)
        edges = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(start), [None, edges, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        edges, distinct = np.frombuffer(chunks.dictionary.buffers()[1], np.int64)[: len(chunks.dictionary) + 1].tolist(), (chunks.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        ids, at = taken(self.parts([distinct[a:b] for a, b in zip(edges, edges[1:])]), chunks.indices.to_numpy())
        return ids, at[np.searchsorted(start, ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        ids, at = self.encode_all(texts)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
