"""Language-model scores: a causal self-attention model over subword ids, mixed with word counts of the corpus.

Texts are lower-cased words and an end. The model reads the subword ids of a text in windows of 16 that overlap by 4, from its own start id on; each
id is scored once, by the last window in which it has the most context. It predicts the class of the next id from what it attends to; within a class, ids follow their
counts over all training texts. Ids that begin a word and ids that go on with one have classes of their own, so the chance that a word ends is known at every
place, and the chances of all words add up to 1 at most. A word's probability is a mixture of three: the class that the model predicts for its first id, and its count
among all training words that begin in this class; its spelling, the product over its ids and its end; and its share of the words before it in the text.

All is learned from the whole training corpus: counts of words and ids; what stands beside each id, from which the ids' features and classes follow; and gradients over
windows that predict each id of each training text once. The weights start on a small sample and then go along gradients that are summed over
partitions, each step on its share of the training texts. All texts are read and encoded once; their ids are written, and counts, gradients and scores come from these.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, subwords, textbytes
from tessera.llm.token_files import runs

#: Training texts that the weights start from, about, before the steps over all training texts; the number of these steps, and their rate.
SAMPLE, STEPS, RATE = 1000, 6, 0.02
#: Words of a segment; one in EVERY segments of a text is trained on, so all are.
SEGMENT, EVERY = 12, 1
#: Ids of a window, and those of them that are context only; width of the model; classes of ids, the first of them of the end, the next of ids that begin a word.
WINDOW, OVERLAP, WIDTH, CLASSES, STARTS = 16, 4, 16, 32, 16
#: Columns in which the neighbours of an id are counted, on each side: the most frequent ids have their own, all others share the last SHARED. Features of an id.
COLUMNS, SHARED, FEATURES = 64, 16, 24
#: The weights in the mixture of counted words and of words met before in the text (the rest is spelled), and what is added to each id's count in its class.
COUNTED, MET, ADDED = 0.7, 0.15, 0.5
#: Bytes of texts whose words are counted together; of neighbours, a quarter of the number.
COUNT_AT_ONCE = 8 << 20
#: Characters of a block of documents that meets the counts of its words, about.
BLOCK = 24 << 20
#: Ids and hashes of words in a row, about, as Spark hands 256 rows at once to Python; and hashes whose counts are added up together.
IDS, HASHES, HASHES_AT_ONCE = 1 << 15, 1 << 12, 200_000

WEIGHTS = ("embed", "place", "q", "k", "v", "o", "out", "bias")
#: Sums a row of chances, and of the chances of classes that begin a word or end the text.
_BOTH = np.stack([np.ones(CLASSES), np.arange(CLASSES) < STARTS], 1).astype(np.float32)


def bounded(x: np.ndarray, most: float) -> None:
    """Cuts x off at -most and most, in place; to look whether anything is beyond is cheaper."""
    if x.size and (x.max() > most or x.min() < -most):
        np.clip(x, -most, most, out=x)


@dataclass
class Model:
    features: np.ndarray  # (ids, FEATURES); the last id is the end
    embed: np.ndarray  # (FEATURES, WIDTH)
    place: np.ndarray  # (WINDOW, WIDTH)
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    o: np.ndarray
    out: np.ndarray  # (WIDTH, CLASSES)
    bias: np.ndarray
    class_of: np.ndarray
    within: np.ndarray  # log10 of p(id | class)

    def attend(self, ids: np.ndarray):
        """Of windows (n, WINDOW) of ids: the states, and what backward needs."""
        n, t = ids.shape
        x = self.features[ids] @ self.embed + self.place[:t]
        flat = x.reshape(-1, WIDTH)
        q, k, v = ((flat @ w).reshape(n, t, WIDTH) for w in (self.q, self.k, self.v))
        s = q @ k.transpose(0, 2, 1)
        s *= WIDTH**-0.5
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= np.tri(t, dtype=s.dtype)
        s /= s @ np.ones((t, 1), s.dtype)
        mixed = s @ v
        return x + (mixed.reshape(-1, WIDTH) @ self.o).reshape(n, t, WIDTH), x, q, k, v, s, mixed

    def states(self, x: np.ndarray, qk: np.ndarray, vo: np.ndarray, causal: np.ndarray) -> np.ndarray:
        """What attend gives from the inputs x of windows, with two products of weights made once: q by k (scaled), and v by o."""
        n, t = x.shape[:2]
        flat = x.reshape(-1, WIDTH)
        s = (flat @ qk).reshape(n, t, WIDTH) @ np.ascontiguousarray(x.transpose(0, 2, 1))
        bounded(s, 30)
        np.exp(s, out=s)
        s *= causal
        s /= (s.reshape(-1, t) @ np.ones((t, 1), s.dtype)).reshape(n, t, 1)
        h = s @ (flat @ vo).reshape(n, t, WIDTH)
        h += x
        return h

    def log10_ids(self, ids: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of each id of a stream given those before it in its text, and log10 of the chance that a word begins, or the text ends, at it; the stream's first id is given, and has 0.

        Each text is given the id before it and adds sizes ids, its end included; without sizes the stream is one text.
        """
        out, begins = np.zeros(len(ids), np.float32), np.zeros(len(ids), np.float32)
        if len(ids) < 2:
            return out, begins
        table = self.features @ self.embed if len(ids) > len(self.features) else None
        at, scored = laid_out(np.array([len(ids) - 1]) if sizes is None else sizes, WINDOW - OVERLAP)
        scored[1:, :OVERLAP] &= at[1:, :1] > at[:-1, -1:]  # unless it's a text's first window, the one before has scored these
        to_log = np.float32(np.log10(np.e))
        qk, vo, causal = (self.q @ self.k.T) * np.float32(WIDTH**-0.5), self.v @ self.o, np.tri(WINDOW, dtype=self.embed.dtype)
        kind = self.class_of[ids]
        for s in range(0, len(at), 128):
            a = at[s : s + 128]
            read = ids.take(a.ravel())
            x = (self.features.take(read, 0) @ self.embed if table is None else table.take(read, 0)).reshape(*a.shape, WIDTH)
            x += self.place
            keep = np.flatnonzero(scored[s : s + 128])
            logits = self.states(x, qk, vo, causal).reshape(-1, WIDTH).take(keep, 0) @ self.out
            logits += self.bias
            bounded(logits, 40)
            to = a.ravel().take(keep) + 1
            chosen = logits.ravel().take(np.arange(0, logits.size, CLASSES) + kind.take(to))
            total = np.log(np.exp(logits, out=logits) @ _BOTH)
            out[to] = chosen - total[:, 0]
            begins[to] = total[:, 1] - total[:, 0]
        out *= to_log
        out[1:] += self.within[ids[1:]]
        begins *= to_log
        return out, begins


def column_of(id_counts: np.ndarray) -> np.ndarray:
    """The column in which each id is counted as a neighbour."""
    out = COLUMNS - SHARED + np.arange(len(id_counts)) % SHARED
    often = np.argsort(-id_counts, kind="stable")[: COLUMNS - SHARED]
    out[often] = np.arange(len(often))
    return out


def features_of(codes: np.ndarray, counts: np.ndarray, n_ids: int) -> np.ndarray:
    """What tells ids apart by their neighbours: the leading directions of the shares of their columns (square roots)."""
    m = np.bincount(codes, counts, n_ids * 2 * COLUMNS).astype(np.float32).reshape(n_ids, -1)
    m = np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1))
    _, vectors = np.linalg.eigh((m.T @ m).astype(np.float64))
    return m @ vectors[:, -FEATURES:].astype(np.float32)


def classes(features: np.ndarray, begins: np.ndarray, id_counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each id: the end has its own; of ids that begin a word, and of the others, those with similar features are together."""
    out = np.zeros(len(features), np.int64)
    for first, last, ids in ((1, STARTS, np.flatnonzero(begins[:-1])), (STARTS, CLASSES, np.flatnonzero(~begins[:-1]))):
        if len(ids) <= last - first:
            out[ids] = first + np.arange(len(ids))
            continue
        x, weight = features[ids], np.sqrt(id_counts[ids] + ADDED).astype(np.float32)
        centre = x[rng.choice(len(x), last - first, replace=False, p=weight.astype(np.float64) / weight.sum(dtype=np.float64))]
        for _ in range(15):
            label = ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)
            total = np.bincount(label, weight, len(centre))
            for d in range(x.shape[1]):
                centre[:, d] = np.where(total > 0, np.bincount(label, weight * x[:, d], len(centre)) / np.maximum(total, 1e-9), centre[:, d])
        out[ids] = first + label
    return out


def laid_out(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows, each of one text only, over a stream of texts that are given their start id and predict sizes ids: positions of the ids that are read, and which are real."""
    windows = np.maximum(1, -(-(sizes - WINDOW + step) // step))
    start = np.cumsum(sizes) - sizes
    number = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.repeat(start, windows) + step * number)[:, None] + np.arange(WINDOW)
    last = np.repeat(start + sizes, windows)[:, None] - 1
    return np.minimum(at, last), at <= last


def gradients(m: Model, ids: np.ndarray, y: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """Of the sum of -ln p(class y) over the real places of windows (n, WINDOW), by the weights. As in states, q meets k, and v meets o, once for all windows."""
    n, t = ids.shape
    kind = m.q.dtype
    scale, causal = kind.type(WIDTH**-0.5), np.tri(t, dtype=kind)
    added = np.ones((max(t, WIDTH, CLASSES), 1), kind)  # rows are added up by products, which are faster than sums along an axis
    qk, vo = (m.q @ m.k.T) * scale, m.v @ m.o
    flat = lambda z: z.reshape(-1, z.shape[-1])
    deep = lambda z: z.reshape(n, t, -1)
    turned = lambda z: np.ascontiguousarray(z.transpose(0, 2, 1))
    f = m.features.take(ids.ravel(), 0)
    x = deep(f @ m.embed)
    x += m.place[:t]
    a = deep(flat(x) @ qk) @ turned(x)
    bounded(a, 30)
    np.exp(a, out=a)
    a *= causal
    a /= deep(flat(a) @ added[:t])
    u = deep(flat(x) @ vo)
    mixed = a @ u
    h = np.ones((n * t, WIDTH + 1), kind)  # the last column is the bias's
    np.add(flat(x), flat(mixed), out=h[:, :WIDTH])
    d = h @ np.concatenate([m.out, m.bias[None]])
    bounded(d, 40)
    np.exp(d, out=d)
    counts = real.ravel().astype(kind)
    d *= counts[:, None] / (d @ added[:CLASSES])
    d.reshape(-1)[np.arange(0, d.size, CLASSES) + y.ravel()] -= counts
    dh = deep(d @ m.out.T)
    du = flat(a.transpose(0, 2, 1) @ dh)
    ds = dh @ turned(u)
    ds -= deep(flat(dh * mixed) @ added[:WIDTH])
    ds *= a
    there, back = flat(ds @ x), flat(ds.transpose(0, 2, 1) @ x)
    dx = du @ vo.T
    dx += flat(dh)
    dx += there @ qk.T
    dx += back @ qk
    by_qk, by_vo, by_out = flat(x).T @ there * scale, flat(x).T @ du, h.T @ d
    g = {"out": by_out[:-1], "bias": by_out[-1], "q": by_qk @ m.k, "k": by_qk.T @ m.q, "v": by_vo @ m.o.T, "o": m.v.T @ by_vo}
    return g | {"place": (np.ones(n, kind) @ dx.reshape(n, -1)).reshape(t, -1), "embed": f.T @ dx}


def untrained(features: np.ndarray, class_of: np.ndarray, id_counts: np.ndarray, rng: np.random.Generator) -> Model:
    total = np.bincount(class_of, id_counts + ADDED, CLASSES)
    within = np.log10((id_counts + ADDED) / total[class_of])
    f = lambda *shape, s=0.1: rng.normal(0, s, shape).astype(np.float32)
    sizes = {"embed": (FEATURES, WIDTH), "place": (WINDOW, WIDTH)} | {w: (WIDTH, WIDTH) for w in "qkvo"} | {"out": (WIDTH, CLASSES)}
    m = Model(features, *(f(*shape, s=1.0 if w == "embed" else 0.25 if w in "qkvo" else 0.1) for w, shape in sizes.items()), np.zeros(CLASSES, np.float32), class_of, within.astype(np.float32))
    m.bias[:] = np.log(np.maximum(total / total.sum(), 1e-13))  # no id, no chance
    return m


def train(m: Model, streams: list[np.ndarray], epochs: int = 2, seed: int = 0) -> None:
    """Along the gradients of streams of ids, in small steps."""
    rng = np.random.default_rng(seed)
    streams = [x for x in streams if len(x) > 1]
    if not streams:
        return
    at, real = laid_out(np.array([len(x) - 1 for x in streams]), WINDOW)
    source, target = np.concatenate([x[:-1] for x in streams])[at], m.class_of[np.concatenate([x[1:] for x in streams])[at]]
    speed = {name: np.full_like(getattr(m, name), 1e-8) for name in WEIGHTS}
    for epoch in range(epochs):
        order = rng.permutation(len(at))
        for s in range(0, len(at), 256):
            some = order[s : s + 256]
            n, rate = real[some].sum(), 0.08 / (1 + epoch)
            for name, grad in gradients(m, source[some], target[some], real[some]).items():
                grad = grad / n
                speed[name] += grad * grad
                getattr(m, name)[...] -= rate * grad / np.sqrt(speed[name])


_tokenizers: dict = {}


def tokenizer_of(path: str):
    """Of this Python worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _tokenizers[path] = tokenizer
    return _tokenizers[path]


_beginning: dict[str, np.ndarray] = {}


def beginning(path: str) -> np.ndarray:
    """Which ids begin a word: those that start with a space; then the end, which does too. The tokenizer must keep spaces in its ids."""
    if path not in _beginning:
        vocab = tokenizer_of(path).get_vocab()
        out = np.zeros(max(vocab.values()) + 2, bool)
        for token, i in vocab.items():
            out[i] = token[:1] in ("\u0120", "\u2581")
        out[-1] = True
        for word in ("a", "of", "#1", "\u00e9"):
            ids = tokenizer_of(path).encode(" " + word, add_special_tokens=False).ids
            if not ids or not out[ids[0]] or out[ids[1:]].any():
                raise ValueError("the tokenizer has no ids that begin words")
        _beginning[path] = out
    return _beginning[path]


_encoders: dict[str, subwords.Kept] = {}

#: White space inside a word, which may be read together with the space that follows.
_ODD = re.compile(r"[^\S ]")


def encoded_words(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word after a space, as 32-bit bytes. Words that aren't UTF-8 are read with replacement characters.

    Words are encoded in a row, which the tokenizer splits at spaces, and cut where ids begin a word; one by one where that may differ.
    """
    tokenizer, begins = tokenizer_of(path), beginning(path)
    out = []
    rows = [[" " + w.decode("utf-8", "replace") for w in words[s : s + subwords.ROW]] for s in range(0, len(words), subwords.ROW)]
    texts = ["".join(some) for some in rows]
    for some, text, e in zip(rows, texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        if not _ODD.search(text):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(begins[ids])
            if len(at) == len(some) and at[0] == 0:
                data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                out += [data[a:b] for a, b in zip(ends, ends[1:])]
                continue
        out += [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    return out


def word_ids(path: str) -> subwords.Kept:
    """Of this Python worker: word (bytes) -> its ids."""
    if path not in _encoders:
        _encoders[path] = subwords.Kept(lambda words: encoded_words(words, path), n=300_000, raw=True)
    return _encoders[path]


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at spaces and the control characters from tab to carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, at_once=COUNT_AT_ONCE):
            t = textbytes.Texts(common.texts(rows.column("text")), lower=True)
            start, end, _ = t.words()
            edges, inside = np.concatenate([[0], np.cumsum(end - start)]), t.data[~textbytes.SPACE[t.data]]
            counts = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(inside)]).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.binary()), counts.field("counts")], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, path: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The count of each subword id, and how many words begin with it, from word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            for s in range(0, len(words), 4096):
                parts = encoded_words(words[s : s + 4096], path)
                ids, sizes, n = np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts]), c[s : s + 4096]
                np.add.at(total, ids, np.repeat(n, sizes))
                np.add.at(first, ids[np.cumsum(sizes) - sizes], n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), pa.array(first[seen])], names=["id", "c", "first"])

    rows = counts.mapInArrow(run, "id long, c long, first long").groupBy("id").agg(F.sum("c").alias("c"), F.sum("first").alias("first")).toArrow()  # at most one row an id
    out = np.zeros((2, size), np.int64)
    out[:, rows.column("id").to_numpy()] = rows.column("c").to_numpy(), rows.column("first").to_numpy()
    return out[0], out[1]


def encoded_chunks(chunks: list[bytes], path: str) -> list[bytes]:
    """The ids of chunks of words: those that begin with a space begin a word."""
    first = [c[:1] == b" " for c in chunks]
    begun = iter(encoded_words([c[1:] for c, is_first in zip(chunks, first) if is_first], path))
    others = [c.decode("utf-8", "replace") for c, is_first in zip(chunks, first) if not is_first]
    rest = iter([np.array(e.ids, "<u4").tobytes() for e in tokenizer_of(path).encode_batch_fast(others, add_special_tokens=False)])
    return [next(begun if is_first else rest) for is_first in first]


def chunk_ids(path: str) -> subwords.Kept:
    """Of this Python worker: chunk of a word (bytes, with a space before the word) -> its ids."""
    key = "chunks " + path
    if key not in _encoders:
        _encoders[key] = subwords.Kept(lambda chunks: encoded_chunks(chunks, path), marks=subwords.marks_of(path), raw=True)
    return _encoders[key]


def ids_of_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words (start and end in data, in order and apart), one after the other, each as after a space; and where each word's begin, with the end of the last."""
    spaced = np.concatenate([[np.uint8(0x20)], data])
    keep = np.zeros(len(spaced) + 1, np.int8)
    keep[start] = 1
    keep[end + 1] -= 1  # words are apart, so no start is an end
    keep = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
    spaced[start] = 0x20  # the byte before each word
    return chunk_ids(path).encode_spans(spaced[keep], np.concatenate([[0], np.cumsum(end - start + 1)]))


def joined(parts: list[bytes], word: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with an end before, between and after them, and how many each text adds, its end included; word: of all words of the texts, sizes of each, its number in parts."""
    ids = np.frombuffer(b"".join([*parts, np.array([end], "<u4").tobytes()]), "<u4").astype(np.int64)
    size = np.array([*(len(p) // 4 for p in parts), 1])
    token = np.full(len(word) + len(sizes) + 1, len(parts))
    token[np.arange(len(word)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = word
    n = size[token]
    to = np.cumsum(n)
    stream = ids[np.arange(to[-1]) + np.repeat((np.cumsum(size) - size)[token] - (to - n), n)]
    return stream, np.diff(to[np.concatenate([[0], np.cumsum(sizes + 1)])])


def segments(texts: list[str], every: int = EVERY) -> list[tuple[list[bytes], bool, bool]]:
    """Of each text one in `every` segments of its words, and one at least, which by its first hash says; whether it begins, and whether it ends the text."""
    out = []
    for text in texts:
        words = words_of(text)
        n = max(1, common.ceil_div(len(words), SEGMENT))
        step = min(every, n)
        for k in range(zlib.crc32(text[:200].encode("utf-8", "surrogatepass")) % step, n, step):
            out.append((words[k * SEGMENT : (k + 1) * SEGMENT], k == 0, k == n - 1))
    return out


def segment_stream(found: list[str], path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts one after the other, all words of each, with the end before and after each text; and how many each has."""
    t = textbytes.Texts(found, lower=True)
    ids, at, sizes = text_ids(t, path)
    return np.insert(ids, np.repeat(at, 2)[1:-1], end) if len(found) else ids, sizes + 2


def text_ids(t: textbytes.Texts, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all words of texts in a row, where each text begins, with the end of the last, and how many each has."""
    first, last, counts = t.words()
    ids, at = ids_of_words(t.data, first, last, path)
    at = at[np.concatenate([[0], np.cumsum(counts)])]
    return ids.astype(np.int64), at, np.diff(at)


def streams(training: DataFrame, path: str, end: int, steps: int = STEPS) -> DataFrame:
    """step, ids, sizes: what segment_stream gives for whole texts, as bytes, some texts in a row. A hash deals the texts to the steps, so partitions don't matter."""
    kind = id_kind(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            stream, sizes = segment_stream(common.texts(rows.column("text")), path, end)
            step = rows.column("step").to_numpy()
            owner = np.repeat(step, sizes)
            for k in np.unique(step).tolist():
                told = [stream[owner == k].astype(kind).tobytes(), sizes[step == k].astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in told)], names=["step", "ids", "sizes"])

    dealt = training.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)).cast("int").alias("step"))
    return dealt.mapInArrow(run, "step int, ids binary, sizes binary")


def word_hashes(stream: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, by its ids, and its place, in a stream of texts with an end before and after each."""
    first = np.flatnonzero(begins[stream])
    is_word = stream[first[:-1]] < len(begins) - 1
    data = stream.astype(id_kind(len(begins) - 1))
    at = first * data.itemsize
    return textbytes.span_hashes(data.view(np.uint8), at[:-1][is_word], at[1:][is_word]), first[:-1][is_word]


class Added:
    """Sums by hash, from arrays of hashes and numbers."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.held = 0

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((h, n))
        self.waiting += len(h)
        if self.waiting > max(1 << 20, self.held):
            self.parts = [self.sums()]
            self.waiting, self.held = 0, len(self.parts[0][0])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and the sum of each."""
        h, n = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(n[order], first) if len(h) else n


ENCODED = "step int, block long, docs array<long>, ids binary, sizes binary, h binary, n binary, many long"


def encoded(docs: DataFrame, path: str, end: int, steps: int = STEPS) -> DataFrame:
    """docs(doc_id, text, training), read once, as rows of ENCODED.

    step says what a row is: below steps, texts of training rows, as streams deals and gives them; steps, other texts; steps + 1, hashes of the words of a block, in order, and how often
    the block's training texts have each; steps + 2, of a task, the counts of the ids and of those that words begin with in training texts. A block is what a task reads one
    after the other, about BLOCK characters. A word is known by the hash of its ids where these tell words apart, else by that of its bytes (h).
    """
    kind, by_ids = id_kind(end), bool(subwords.marks_of(path))

    def row(step: int, block: int, **told: object) -> pa.RecordBatch:
        types = {"docs": pa.list_(pa.int64()), "ids": pa.binary(), "sizes": pa.binary(), "h": pa.binary(), "n": pa.binary(), "many": pa.int64()}
        columns = [pa.array([step], pa.int32()), pa.array([block], pa.int64()), *(pa.array([told.get(c)], t) for c, t in types.items())]
        return pa.RecordBatch.from_arrays(columns, names=["step", "block", *types])

    def block_rows(words: Added, block: int) -> Iterator[pa.RecordBatch]:
        h, n = words.sums()
        for s in range(0, len(h), HASHES):
            some = h[s : s + HASHES]
            yield row(steps + 1, block, h=some.tobytes(), n=n[s : s + HASHES].tobytes(), many=len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, block = beginning(path), TaskContext.get().partitionId() << 32
        total, first, words, size = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64), Added(), 0
        for rows in runs(batches):
            found = common.texts(rows.column("text"))
            t = textbytes.Texts(found, lower=True)
            start, last, counts = t.words()
            ids, at = ids_of_words(t.data, start, last, path)
            at = at[np.concatenate([[0], np.cumsum(counts)])]
            stream, sizes = np.insert(ids.astype(np.int64), np.repeat(at, 2)[1:-1], end), np.diff(at) + 2
            h = word_hashes(stream, begins)[0] if by_ids else textbytes.span_hashes(t.data, start, last)
            step = rows.column("step").to_numpy()
            in_training = step < steps
            u, word = np.unique(h, return_inverse=True)
            words.add(u, np.bincount(word, np.repeat(in_training, counts), len(u)).astype(np.int64))
            owner, word_owner, docs = np.repeat(step, sizes), np.repeat(step, counts), rows.column("doc_id")
            for k in np.unique(step).tolist():
                mine, some = step == k, stream[owner == k]
                if k < steps:
                    total += np.bincount(some, minlength=end + 1)
                names, hashes, n, of = docs.filter(pa.array(mine)).to_pylist(), h[word_owner == k], sizes[mine], counts[mine]
                at, word_at = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(of)])
                cuts = np.flatnonzero(np.diff(at[:-1] // IDS, prepend=-1)).tolist()  # before the first text that begins in each IDS
                for a, b in zip(cuts, [*cuts[1:], len(n)]):
                    told = {"docs": names[a:b], "ids": some[at[a] : at[b]].astype(kind).tobytes(), "sizes": n[a:b].astype("<i8").tobytes()}
                    yield row(k, block, **told, h=None if by_ids else hashes[word_at[a] : word_at[b]].tobytes())
            size += sum(map(len, found))
            if size >= BLOCK:
                yield from block_rows(words, block)
                words, size, block = Added(), 0, block + 1
        yield from block_rows(words, block)
        if total.any():
            total[end] //= 2  # a text has one before it, too
            first[begins] = total[begins]  # such an id is a word's first
            yield row(steps + 2, block, ids=total.tobytes(), sizes=first.tobytes())

    dealt = F.when(F.col("training"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)).cast("int")).otherwise(steps)
    return docs.select("doc_id", "text", dealt.alias("step")).mapInArrow(run, ENCODED)


def added_ids(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The count of each id, and how many words begin with it, from what encoded gives of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for k, name in enumerate(("ids", "sizes")):
                for x in batch.column(name):
                    total[k] += np.frombuffer(x.as_py(), np.int64)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, *total[:, seen])], names=["id", "c", "first"])

    found = rows.select("ids", "sizes").mapInArrow(run, "id long, c long, first long").groupBy("id").agg(F.sum("c").alias("c"), F.sum("first").alias("first")).toArrow()  # at most one row an id
    out = np.zeros((2, size), np.int64)
    out[:, found.column("id").to_numpy()] = found.column("c").to_numpy(), found.column("first").to_numpy()
    return out[0], out[1]


def block_counts(rows: DataFrame) -> DataFrame:
    """block, h, n, many: the counts over all training texts of a block's words that these have, from what encoded gives of blocks; and, with block -1, how many distinct words they have."""
    hashes = rows.agg(F.sum("many")).first()[0] or 0
    shares = max(rows.sparkSession.sparkContext.defaultParallelism, common.ceil_div(hashes, HASHES_AT_ONCE))
    edges = np.array([(k << 64) // shares for k in range(1, shares)], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, h, n in zip(batch.column("block").to_pylist(), batch.column("h"), batch.column("n")):
                h, n = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)
                cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                parts = [(k, h[a:b].tobytes(), n[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                share, some, numbers = zip(*parts)
                yield pa.RecordBatch.from_arrays([pa.array(share, pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(some, pa.binary()), pa.array(numbers, pa.binary())], names=["share", "block", "h", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, h, n, sizes = [], [], [], []
        for batch in batches:
            block += batch.column("block").to_pylist()
            h += [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("h")]
            n += [np.frombuffer(x.as_py(), np.int64) for x in batch.column("n")]
        if not block:
            return
        u, word = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(word, np.concatenate(n), len(u)).astype(np.int64)
        told, at = [(-1, b"", b"", int((total > 0).sum()))], 0
        for b, some in zip(block, h):
            c = total[word[at : at + len(some)]]
            at += len(some)
            known = c > 0
            told.append((b, some[known].tobytes(), c[known].tobytes(), 0))
        for s in range(0, len(told), 64):
            columns = zip(*told[s : s + 64])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["block", "h", "n", "many"])

    dealt = rows.select("block", "h", "n").mapInArrow(deal, "share int, block long, h binary, n binary")
    return dealt.repartition(shares, "share").mapInArrow(add, "block long, h binary, n binary, many long")


def id_kind(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


def read_streams(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    kind = id_kind(end)
    _encoders.clear()  # this worker may have encoded texts before; it has ids now
    for batch in batches:
        for ids, sizes in zip(batch.column("ids"), batch.column("sizes")):
            yield np.frombuffer(ids.as_py(), kind).astype(np.int64), np.frombuffer(sizes.as_py(), "<i8")


def neighbours_of(training: DataFrame, id_counts: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of what stands beside each id in all training texts."""
    return counted_neighbours(streams(training, path, len(id_counts) - 1), id_counts)


def counted_neighbours(rows: DataFrame, id_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As neighbours_of, from streams."""
    column, end = column_of(id_counts), len(id_counts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(len(column) * 2 * COLUMNS, np.int32), [], 0  # of a task

        def count() -> None:
            nonlocal waiting, size
            if waiting:
                total[:] += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.int32)
            waiting, size = [], 0

        for stream, sizes in read_streams(batches, end):
            inside = np.ones(max(len(stream) - 1, 0), bool)
            inside[np.cumsum(sizes)[:-1] - 1] = False
            row, by = stream * (2 * COLUMNS), column[stream]
            waiting += [(row[:-1] + by[1:])[inside], (row[1:] + (by[:-1] + COLUMNS))[inside]]
            size += 2 * len(stream)
            if size >= COUNT_AT_ONCE >> 2:
                count()
        count()
        codes = np.flatnonzero(total)
        for s in range(0, len(codes), 1 << 16):
            some = codes[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], names=["code", "n"])

    found = rows.select("ids", "sizes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()  # at most 2 * COLUMNS an id
    return found.column("code").to_numpy(), found.column("n").to_numpy()


def windows_of_segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over a stream of segments, each predicting all but its first id."""
    start = np.cumsum(sizes) - sizes
    some = sizes > 1
    at, real = laid_out(sizes[some] - 1, WINDOW)
    return at + np.repeat(start[some] - (np.cumsum(sizes[some] - 1) - (sizes[some] - 1)), np.maximum(1, -(-(sizes[some] - 1) // WINDOW)))[:, None], real


def summed_gradients(m: Model, rows: DataFrame) -> tuple[np.ndarray, int]:
    """The sum of the gradients over all texts in rows of streams, and the ids predicted: all but the end before each text."""
    held = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        total, n = [np.zeros(getattr(m, name).shape) for name in WEIGHTS], 0
        for stream, sizes in read_streams(batches, len(m.features) - 1):
            at, real = windows_of_segments(sizes)
            for s in range(0, len(at), 128):
                a, r = at[s : s + 128], real[s : s + 128]
                g = gradients(m, stream[a], m.class_of[stream[a + 1]], r)
                for sums, name in zip(total, WEIGHTS):
                    sums += g[name]
                n += int(r.sum())
        flat = np.concatenate([x.ravel() for x in total] + [[n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "x"])

    found = rows.select("ids", "sizes").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow()  # one number a weight
    flat = found.column("x").to_numpy()
    return (flat[:-1], int(flat[-1])) if len(flat) else (flat, 0)


def train_on_all(m: Model, rows: DataFrame, steps: int = STEPS) -> None:
    """Steps along the gradients of all training texts, each on its rows of streams."""
    speed = {name: np.full(getattr(m, name).shape, 1e-8) for name in WEIGHTS}
    for step in range(steps):
        flat, n = summed_gradients(m, rows.filter(F.col("step") == step))
        if n:
            ends = np.cumsum([getattr(m, name).size for name in WEIGHTS])
            for name, part in zip(WEIGHTS, np.split(flat / n, ends[:-1])):
                g = part.reshape(getattr(m, name).shape)
                speed[name] += g * g
                getattr(m, name)[...] -= (RATE * g / np.sqrt(speed[name])).astype(np.float32)


def fit(training: DataFrame, counts: DataFrame, n_docs: int, path: str, sample: int = SAMPLE) -> tuple[Model, np.ndarray]:
    """The model of training(doc_id, text), and class_totals: counts, neighbours and gradients of the whole corpus, from a start on about `sample` texts, chosen evenly by a hash."""
    begins = beginning(path)
    id_counts, first = subword_counts(counts, path, len(begins))
    id_counts[-1] += n_docs
    where = common.new_path(training.sparkSession, "streams")
    dealt = streams(training, path, len(id_counts) - 1)
    dealt.write.partitionBy("step").parquet(where)
    m = learned(training, training.sparkSession.read.schema(dealt.schema).parquet(where), id_counts, path, sample)
    common.drop(training.sparkSession, where)
    return m, class_totals(first, m.class_of)


def learned(training: DataFrame, dealt: DataFrame, id_counts: np.ndarray, path: str, sample: int = SAMPLE) -> Model:
    """The model of training(doc_id, text), given its streams and the counts of its ids."""
    begins, n_docs = beginning(path), int(id_counts[-1])
    share = min(1.0, sample / max(n_docs, 1))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    rows = training.filter("text IS NOT NULL").filter(spread < int(1_000_000 * share)).select("doc_id", "text").toArrow()
    got = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()), key=lambda r: (r[0] is None, r))
    rng = np.random.default_rng(0)
    features = features_of(*counted_neighbours(dealt, id_counts), len(id_counts))
    m = untrained(features, classes(features, begins, id_counts, rng), id_counts, rng)
    stream, sizes = segment_stream([text for _, text in got], path, len(id_counts) - 1)
    train(m, np.split(stream, np.cumsum(sizes)[:-1]))
    train_on_all(m, dealt)  # the streams are read once for the neighbours and once for the steps together
    return m


def class_totals(first: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """The training words, by the class of their first id; first: how many begin with each id."""
    out = np.zeros(CLASSES, np.int64)
    np.add.at(out, class_of, first)
    return out


def met_before(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The share of each word (numbers below 2**31) among the words before it in its text."""
    place, text = np.arange(len(words)), textbytes.owners(sizes)
    order = np.sort(words.astype(np.int64) << 32 | place) & 0xFFFFFFFF  # by word, then by place
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    times = np.empty(len(words), np.int64)
    times[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return times / np.maximum(place - np.repeat(np.cumsum(sizes) - sizes, sizes), 1)


def token_logs(ids: np.ndarray, logs: np.ndarray, begins: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word and end of texts in a row, given that one begins there: log10 p of its spelling (its ids, and then a word begins or the text ends), log10 p of its first id's class, and that class."""
    first = np.flatnonzero(m.class_of[ids] < STARTS)
    kind = m.class_of[ids[first]]
    spelled = np.add.reduceat(logs.astype(np.float64), first) - begins[first]
    inner = np.flatnonzero(kind > 0)  # a word is always followed by a word or an end
    spelled[inner] += begins[first[inner + 1]]
    return spelled, (logs[first] - m.within[ids[first]] - begins[first]).astype(np.float64), kind


def score(df: DataFrame, is_training: Column, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of df(doc_id, text), learned from the rows for which is_training holds.

    Tokens are the words of the text (A-Z lower-cased) and an end. base_score is the sum of log10((c + 0.1) / (N + 0.1 * (V + 1))); score is the log10 probability
    of the mixture. A null or empty text is an end alone. Repeated rows are scored alike but for rounding, however rows are partitioned, whole texts
    however long; extra columns are ignored. Without training rows N is 0 and the base gives each token log10(0.1 / 0.1) = 0. An empty table gives no rows.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    path = tokenizer or subwords.default_path()
    docs = df.select("doc_id", "text", F.coalesce(is_training, F.lit(False)).alias("training"))
    begins = beginning(path)
    end, where = len(begins) - 1, common.new_path(spark, "encoded")
    encoded(docs, path, end).write.partitionBy("step").parquet(where)
    rows = spark.read.schema(ENCODED).parquet(where)
    known, known_path = common.written(block_counts(rows.filter(F.col("step") == STEPS + 1)), "block-words")
    common.drop(spark, f"{where}/step={STEPS + 1}")
    id_counts, first = added_ids(rows.filter(F.col("step") == STEPS + 2), len(begins))
    n_docs = int(id_counts[end])
    n, v = int(first.sum()), (known.agg(F.sum("many")).first()[0] or 0) + (n_docs > 0)  # each end is one, too
    model = learned(docs.filter("training"), rows.filter(F.col("step") < STEPS), id_counts, path)
    first[end] = 0
    held = spark.sparkContext.broadcast((model, class_totals(first, model.class_of)))
    none = lambda *names: [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    words = known.filter("block >= 0").select("block", F.lit(0).alias("kind"), *none("docs", "ids", "sizes"), "h", "n")
    texts = rows.filter(F.col("step") <= STEPS).select("block", F.lit(1).alias("kind"), "docs", "ids", "sizes", "h", "n")
    tasks = 4 * max(spark.sparkContext.defaultParallelism, rows.filter(F.col("step") <= STEPS).select("block").distinct().count())
    ordered = words.union(texts).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    scale = n + 0.1 * (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, totals = held.value
        begins_word = beginning(path)
        at, keys, values = None, [], []
        table_h = table_c = np.zeros(0, np.int64)

        def close() -> None:
            nonlocal table_h, table_c, keys, values
            table_h = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            order = np.argsort(table_h)
            table_h, table_c = table_h[order], (np.concatenate(values) if values else np.zeros(0, np.int64))[order]
            keys, values = [], []

        def count_of(h: np.ndarray) -> np.ndarray:
            if not len(table_h):
                return np.zeros(len(h), np.int64)
            k = np.minimum(np.searchsorted(table_h, h), len(table_h) - 1)
            return np.where(table_h[k] == h, table_c[k], 0)

        def scored(docs: list, stream: np.ndarray, sizes_in_ids: np.ndarray, told: bytes | None) -> pa.RecordBatch:
            h, place = word_hashes(stream, begins_word)
            h = h if told is None else np.frombuffer(told, np.uint64)
            starts = np.cumsum(sizes_in_ids) - sizes_in_ids
            sizes = np.diff(np.append(np.searchsorted(place, starts), len(place)))
            u, word = np.unique(h, return_inverse=True)
            c = count_of(u)[word]
            base = textbytes.sums(np.log10((c + 0.1) / scale), sizes) + np.log10((n_docs + 0.1) / scale)
            stream, sizes_in_ids = np.delete(stream, starts[1:]), sizes_in_ids - 1  # a text's end is before the next one
            logs, begins = model.log10_ids(stream, sizes_in_ids)
            spelled, kind_log, kind = token_logs(stream[1:], logs[1:], begins[1:], model)
            is_word = kind > 0
            counted, met = np.zeros(len(kind)), np.zeros(len(kind))
            counted[is_word] = c / np.maximum(totals[kind[is_word]], 1)
            counted[~is_word] = 1.0  # the end is alone in its class
            met[is_word] = met_before(word, sizes)
            after = np.ones(len(kind), bool)
            after[np.cumsum(sizes + 1) - (sizes + 1)] = False  # a text's first token has none before it
            by_count, by_text = (COUNTED if n else 0.0), np.where(after, MET, 0.0)
            by_spelling = 1 - by_count - by_text
            likely = by_count * counted * 10.0**kind_log + by_text * met + by_spelling * 10.0 ** np.maximum(spelled, -300)
            mixed = np.maximum(np.log10(np.maximum(likely, 1e-300)), np.log10(by_spelling) + spelled)  # very long words are below what a float holds
            mixed = np.where(likely > 1e-290, mixed, np.log10(by_spelling) + spelled)
            known_n = textbytes.sums(c > 0, sizes) + (n_docs > 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array((sizes + 1).astype(np.int64)), pa.array(known_n.astype(np.int64)), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base), pa.array(textbytes.sums(mixed, sizes + 1))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            for k, (block, kind) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist())):
                if block != at:
                    at, keys, values = block, [], []
                    table_h = table_c = np.zeros(0, np.int64)
                if not kind:
                    keys.append(np.frombuffer(batch.column("h")[k].as_py(), np.uint64))
                    values.append(np.frombuffer(batch.column("n")[k].as_py(), np.int64))
                    continue
                if keys:
                    close()
                stream, sizes = next(read_streams([batch.slice(k, 1)], end))
                yield scored(batch.column("docs")[k].as_py(), stream, sizes, batch.column("h")[k].as_py())

    return ordered.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return common.crc_bucket(doc_id, 10) == 0


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(common.documents(spark, sf_dir), ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
