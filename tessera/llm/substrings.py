"""Exact removal of repeated passages, by sharded suffix arrays.

A byte goes if a string of 200 bytes that covers it also starts somewhere else. Each such window of 200 bytes has one anchor: of its 137 strings of
64 bytes the one with the least hash (the first of several). Equal windows have equal anchors at equal offsets, so

1. the windows of a document fall into runs with one anchor each; only anchors that occur twice or more in the corpus are of interest;
2. a run whose whole text occurs again is repeated as a whole; counts of hashes tell;
3. distinct texts of runs with the same anchor meet in a shard. There, suffix arrays (Larsson and Sadakane) with common prefixes (Kasai) tell
   the windows that occur again. The runs of a very frequent anchor are split over several shards; each sends on the sorted windows that
   it couldn't decide alone, each once, and these are merged by binary search, in ranges of their hashes.

Everything is exact up to collisions of hashes of 128 bits (64 bits besides an equal anchor); hashes go through permutations at each step, so no pattern of
bytes cancels out. Passages never leave their document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, textbytes
from tessera.llm.suffixes import common_prefixes, suffix_array

#: Bytes of an anchor, for windows of 200; parts of the anchor's offsets that are told apart in a shard.
ANCHOR, PARTS = 64, 4
#: Distinct runs of one anchor that a shard takes.
SHARD_RUNS = 512
#: Bytes that one suffix array holds, about, and of texts whose anchors are found together.
ARRAY_BYTES, PIECE = 1 << 20, 1 << 19
#: Shards of a split anchor for each range of hashes in which their windows are merged.
SHARDS_A_RANGE = 4

U = np.uint64


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on: of 8 bytes, then of two halves again and again."""
    h = textbytes.mixed(textbytes.words_at(data)[: max(len(data) - 7, 0)] + U(0x9E3779B97F4A7C15))
    size = 8
    while size < ANCHOR:
        h = textbytes.mixed(h[: max(len(h) - size, 0)] * U(0x9FB21C651E98DF25) + h[size:])
        size *= 2
    return h


def long_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each span a..b of ANCHOR bytes or more, from the hashes h of all anchors: side by side, and the last that fits."""
    out = textbytes.mixed((b - a).astype(U) * U(0xC2B2AE3D27D4EB4F))
    live, at = np.arange(len(a)), a
    while len(live):
        out[live] = textbytes.mixed(out[live] * U(0x9FB21C651E98DF25) ^ h[at])
        more = at + 2 * ANCHOR <= b[live]
        live, at = live[more], at[more] + ANCHOR
    return textbytes.mixed(out * U(0x9FB21C651E98DF25) ^ h[b - ANCHOR])


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    m, s = h, 1
    while s * 2 <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[: len(m) - (w - s)], m[w - s :]) if w > s else m


def anchors(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The runs of windows of `length` bytes in texts at start..end of data: text, place of the anchor in the text, offsets of the anchor in the first and in the last window, hashes of
    the anchor and of the run's whole text. data is shorter than 2**24 bytes."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "place", "first", "last", "fp", "run")}
    long = np.flatnonzero(end - start >= length)
    if not len(long):
        return none
    h = anchor_hashes(data)
    low = U((1 << 24) - 1)
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=U), length - ANCHOR + 1)
    n = end[long] - start[long] - length + 1
    window = np.repeat(start[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    at = (least[window] & low).astype(np.int64)
    cut = np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at)) - 1
    at, w0, w1 = at[first], window[first], window[last]
    text = np.searchsorted(end, at, "right")
    run = textbytes.mixed(long_hashes(h, w0, w1 + length) + (at - w0).astype(U) * U(0xC2B2AE3D27D4EB4F) + (w1 - w0).astype(U) * U(0x165667B19E3779F9))
    return {"text": text, "place": at - start[text], "first": at - w0, "last": at - w1, "fp": h[at].view(np.int64), "run": run.view(np.int64)}


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """d, k, fp, run, place, first, last for each run of windows of docs(d, k, text)."""
    names = ["d", "k", "fp", "run", "place", "first", "last"]

    def group(rows: pa.RecordBatch, some: list[int], found: list[bytes]) -> Iterator[pa.RecordBatch]:
        d, k = (rows.column(c).to_numpy()[some] for c in ("d", "k"))
        data = np.frombuffer(b"".join(found), np.uint8)
        end = np.cumsum([len(x) for x in found])
        start = end - np.array([len(x) for x in found])
        for a in range(0, max(len(data) - length + 1, 0), PIECE):  # long texts: pieces of windows, each with the bytes after them
            b = min(len(data), a + PIECE + length - 1)
            s, e = np.clip(start, a, b) - a, np.clip(end, a, b) - a
            got = anchors(data[a:b], s, e, length)
            t = got["text"]
            place = got["place"] + (s[t] + a - start[t])
            yield pa.RecordBatch.from_arrays([pa.array(d[t]), pa.array(k[t]), pa.array(got["fp"]), pa.array(got["run"]), pa.array(place), pa.array(got["first"].astype(np.int32)), pa.array(got["last"].astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.cache_of("substrings")
        for batch in batches:
            some, found, size = [], [], 0
            for i, text in enumerate(common.texts(batch.column("text")) if batch.num_rows else ()):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= length:
                    some.append(i)
                    found.append(data)
                    size += len(data)
                if size > PIECE:
                    yield from group(batch, some, found)
                    some, found, size = [], [], 0
            if some:
                yield from group(batch, some, found)

    return docs.mapInArrow(run, "d long, k long, fp long, run long, place long, first int, last int")


def run_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted(d, k, runs) with the text of each run: fp, run, shard, shards, n, first, last, bytes."""
    names = ["fp", "run", "shard", "shards", "n", "first", "last", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.cache_of("substrings")
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for key, text, runs in zip(zip(batch.column("d").to_pylist(), batch.column("k").to_pylist()), common.texts(batch.column("text")), batch.column("runs")):
                if key in seen:  # a repeated row
                    continue
                seen.add(key)
                data = text.encode("utf-8", "surrogatepass")
                flat = runs.values.flatten()
                fields = dict(zip([f.name for f in runs.values.type], flat))
                place, first, last = (fields[c].to_numpy() for c in ("place", "first", "last"))
                found = [data[a:b] for a, b in zip((place - first).tolist(), (place - last + length).tolist())]
                yield pa.RecordBatch.from_arrays([fields[c] for c in names[:-1]] + [pa.array(found, pa.binary())], names=names)

    return docs.join(wanted, ["d", "k"]).select("d", "k", "text", "runs").mapInArrow(run, "fp long, run long, shard int, shards int, n long, first int, last int, bytes binary")


class Shard:
    """Distinct runs of whole anchors (or of parts of frequent ones): which of their windows occur again within the shard."""

    def __init__(self, fp: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, found: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(found), np.uint8)
        self.size = np.array([len(x) for x in found])
        self.start = np.cumsum(self.size) - self.size
        self.windows = first - last + 1
        self.w_start = np.cumsum(self.windows) - self.windows  # each run's windows in `repeated`
        self.repeated = np.repeat(n > 1, self.windows)
        self.anchors = anchor_hashes(self.data)
        self.fp, self.first, self.last, self.n = fp, first, last, n

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return long_hashes(self.anchors, a, b)

    def units(self) -> dict[str, np.ndarray]:
        """Each run cut by the offset of the anchor into PARTS; a window of a part contains the part's core, so a part whose core no other run has is done."""
        reach = self.length - ANCHOR
        step = -(-(reach + 1) // PARTS)
        out = []
        for j in range(PARTS):
            lo, hi = j * step, min((j + 1) * step - 1, reach)  # offsets of the anchor in the part's windows
            here = np.flatnonzero((self.last <= hi) & (self.first >= lo))
            w0, w1 = self.first[here] - np.minimum(self.first[here], hi), self.first[here] - np.maximum(self.last[here], lo)
            anchor = self.start[here] + self.first[here]
            core = self.hashes(anchor - lo, anchor - hi + self.length)
            a, b = self.start[here] + w0, self.start[here] + w1 + self.length
            whole = self.hashes(a, b) + textbytes.mixed(((self.first[here] - w0) * 512 + w1 - w0).astype(U))
            out.append((here, w0, w1, a, b, textbytes.mixed(core ^ textbytes.mixed(self.fp[here].view(U) + U(j))), textbytes.mixed(whole ^ core)))
        return dict(zip(("run", "w0", "w1", "a", "b", "core", "whole"), map(np.concatenate, zip(*out))))

    def mark(self, run: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> None:
        cover = np.zeros(len(self.repeated) + 1, np.int32)
        np.add.at(cover, self.w_start[run] + w0, 1)
        np.add.at(cover, self.w_start[run] + w1 + 1, -1)
        self.repeated |= np.cumsum(cover[:-1]) > 0

    def solve(self) -> None:
        u = self.units()
        keep = textbytes.repeated(u["core"])
        u = {k: v[keep] for k, v in u.items()}
        twice = textbytes.repeated(u["whole"])
        self.mark(u["run"][twice], u["w0"][twice], u["w1"][twice])
        # one unit for each distinct text goes on, if its core has a unit that isn't settled
        open_ = ~twice & (self.n[u["run"]] < 2)
        _, one = np.unique(u["whole"], return_index=True)
        u = {k: v[one] for k, v in (u | {"open": open_}).items()}
        cores = np.unique(u["core"][u["open"]])
        u = {k: v[np.isin(u["core"], cores)] for k, v in u.items()}
        order = np.argsort(u["core"], kind="stable")
        u = {k: v[order] for k, v in u.items()}
        total = np.cumsum(u["b"] - u["a"])
        edge = np.flatnonzero(np.concatenate([[True], u["core"][1:] != u["core"][:-1]])) if len(total) else np.zeros(0, int)
        s = 0
        while s < len(total):
            base = total[s - 1] if s else 0
            more = edge[(edge > s) & (total[np.maximum(edge - 1, 0)] - base >= ARRAY_BYTES)]
            e = int(more[0]) if len(more) else len(total)
            self.by_suffixes({k: v[s:e] for k, v in u.items()})
            s = e

    def by_suffixes(self, u: dict[str, np.ndarray]) -> None:
        size = u["b"] - u["a"]
        start = np.cumsum(size + 1) - (size + 1)
        text = np.full(int((size + 1).sum()), 0xFF, np.uint8)  # no byte of UTF-8, between units
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(start, size) + inner] = self.data[np.repeat(u["a"], size) + inner]
        array, place = suffix_array(text, self.length)
        shared = common_prefixes(text, array, place, self.length)
        again = shared >= self.length
        again[:-1] |= again[1:]
        n = u["w1"] - u["w0"] + 1
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = again[place[np.repeat(start, n) + k]]
        self.repeated[(np.repeat(self.w_start[u["run"]] + u["w0"], n) + k)[hit]] = True

    def window_hashes(self) -> np.ndarray:
        k = np.arange(len(self.repeated)) - np.repeat(self.w_start, self.windows)
        a = np.repeat(self.start, self.windows) + k
        return textbytes.mixed(self.hashes(a, a + self.length) ^ np.repeat(textbytes.mixed(self.fp.view(U)), self.windows))


def range_bits(shards: int) -> int:
    """The ranges of hashes for the windows of an anchor in so many shards are this power of two."""
    return max(0, -(-shards // SHARDS_A_RANGE) - 1).bit_length()


FOUND = "fp long, run long, shard int, part int, id int, windows binary, low binary, hashes binary, own binary"


def solved(runs: DataFrame, length: int) -> DataFrame:
    """For each distinct run the repeated windows, as bits (part -1). For anchors in several shards also the hashes of their windows, sorted and cut into ranges (part 0 and on), with places to give answers to."""

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        fp, run, shard, shards, n, first, last = (t.column(c).to_numpy() for c in ("fp", "run", "shard", "shards", "n", "first", "last"))
        s = Shard(fp, first.astype(np.int64), last.astype(np.int64), n, t.column("bytes").to_pylist(), length)
        s.solve()
        bits = [np.packbits(s.repeated[a : a + w]).tobytes() for a, w in zip(s.w_start, s.windows)]
        m = len(fp)
        none = [None] * m
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(run), pa.array(shard), pa.array(np.full(m, -1, np.int32)), pa.array(np.zeros(m, np.int32)), pa.array(bits, pa.binary()), *[pa.array(none, pa.binary())] * 3], names=[f.split()[0] for f in FOUND.split(", ")])
        split = np.repeat(shards > 1, s.windows)
        if not split.any():
            return
        hashes = s.window_hashes()
        owner = np.repeat(np.arange(m), s.windows)
        place = np.arange(len(hashes)) - np.repeat(s.w_start, s.windows)
        for key in np.unique(fp[shards > 1]):
            at = np.flatnonzero(split & (fp[owner] == key))
            at = at[np.unique(hashes[at], return_index=True)[1]]  # sorted; those that occur again here are known to be repeated
            bits = range_bits(int(shards[owner[at[0]]]))
            for part, some in enumerate(np.split(at, np.searchsorted(hashes[at], np.arange(1, 1 << bits, dtype=U) << U(64 - bits)) if bits else [])):
                if len(some):
                    told = [run[owner[some]].astype("<i8").tobytes(), place[some].astype("<i4").tobytes(), hashes[some].astype("<u8").tobytes(), s.repeated[some].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([0], pa.int64()), pa.array([shard[owner[some[0]]]], pa.int32()), pa.array([part], pa.int32()), pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in told)], names=[f.split()[0] for f in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.cache_of("substrings")
        held: list[pa.RecordBatch] = []
        size, at = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("fp").to_pylist(), batch.column("shard").to_pylist()))
            sizes = np.cumsum([len(x) for x in batch.column("bytes").to_pylist()])
            a = taken = 0
            for i, key in enumerate(keys):
                before = int(sizes[i - 1]) if i else 0
                if key != at and size + before - taken > ARRAY_BYTES:  # only between anchors
                    if i > a:
                        held.append(batch.slice(a, i - a))
                    if held:
                        yield from flush(held)
                    held, size, a, taken = [], 0, i, before
                at = key
            held.append(batch.slice(a))
            size += int(sizes[-1]) - taken
        if held:
            yield from flush(held)

    return runs.repartition("fp", "shard").sortWithinPartitions("fp", "shard").mapInArrow(run, FOUND)


def merged(parts: DataFrame) -> DataFrame:
    """fp, run, windows (bits) that the shards of one anchor find together. A range of one anchor's hashes meets in one task: sorted arrays, searched for equal neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key, rows):
            runs, place, hashes, own = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in ((0, "<i8"), (1, "<i4"), (2, "<u8"), (3, "?")))
            every = np.sort(hashes)
            hit = (np.searchsorted(every, hashes, "right") - np.searchsorted(every, hashes, "left") > 1) & ~own
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([runs[hit].tobytes()], pa.binary()), pa.array([place[hit].tobytes()], pa.binary())], names=["fp", "runs", "places"])

        at, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = row["fp"], row["part"]
                if key != at and rows:
                    yield from flush(at, rows)
                    rows = []
                at = key
                rows.append((row["windows"], row["low"], row["hashes"], row["own"]))
        if rows:
            yield from flush(at, rows)

    return parts.repartition("fp", "part").sortWithinPartitions("fp", "part").mapInArrow(run, "fp long, runs binary, places binary")


def merged_rows(hits: DataFrame) -> DataFrame:
    """fp, run, windows (bits) of each run that has a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                runs, place = np.frombuffer(row["runs"], "<i8"), np.frombuffer(row["places"], "<i4")
                order = np.argsort(runs, kind="stable")
                runs, place = runs[order], place[order]
                ids, first = np.unique(runs, return_index=True)
                bits = []
                for some in np.split(place, first[1:]):
                    b = np.zeros(int(some.max()) + 1, bool)
                    b[some] = True
                    bits.append(np.packbits(b).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["fp"])), pa.array(ids), pa.array(bits, pa.binary())], names=["fp", "run", "windows"])

    return hits.mapInArrow(run, "fp long, run long, windows binary")


def intervals(rows: DataFrame, length: int) -> DataFrame:
    """d, k, a, b (removed bytes) from d, k, place, first, last, n and the bits of the windows (null: none but if n > 1 all)."""
    names = ["d", "k", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k, place, first, last = (batch.column(c).to_numpy() for c in ("d", "k", "place", "first", "last"))
            n = batch.column("n").to_numpy()
            every = np.flatnonzero(n > 1)
            out = [(every, (place - first)[every], (place - last + length)[every])]
            windows = batch.column("windows")
            for i in np.flatnonzero((n < 2) & ~windows.is_null().to_numpy(zero_copy_only=False)):
                bits = np.unpackbits(np.frombuffer(windows[int(i)].as_py(), np.uint8))[: first[i] - last[i] + 1].astype(np.int8)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]])))
                if len(edge):
                    a, b = edge[::2], edge[1::2] - 1
                    out.append((np.full(len(a), i), place[i] - first[i] + a, place[i] - first[i] + b + length))
            at, a, b = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(k[at]), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=names)

    return rows.select("d", "k", "place", "first", "last", "n", "windows").mapInArrow(run, "d long, k long, a long, b long")


def find_repeats(docs: DataFrame, length: int) -> DataFrame:
    """d, k, spans (array of a, b): bytes of docs(d, k, text) that repeated strings of `length` bytes cover; spans may overlap. Written to shared storage."""
    spark = docs.sparkSession
    common.small_batches(spark)
    every, every_path = common.written(anchored(docs, length), "anchors")
    often, often_path = common.written(every.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select("fp"), "often")
    rows, rows_path = common.written(every.join(often, "fp"), "repeated-anchors")
    common.drop(spark, every_path, often_path)
    at = F.xxhash64("d", "k", "place")  # one row stands for all with a run; first and last are alike in all
    one = [F.min_by(c, at).alias(c) for c in ("d", "k", "place")] + [F.min(c).alias(c) for c in ("first", "last")]
    kinds = rows.groupBy("fp", "run").agg(F.count("*").alias("n"), *one)
    kinds, kinds_path = common.written(kinds, "runs")
    groups, groups_path = common.written(kinds.groupBy("fp").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("fp", F.ceil(F.col("kinds") / SHARD_RUNS).cast("int").alias("shards")), "groups")
    some = kinds.join(groups, "fp").withColumn("shard", F.pmod(F.xxhash64("run"), F.col("shards")).cast("int"))
    wanted = some.select("d", "k", F.struct("fp", "run", "shard", "shards", "n", "place", "first", "last").alias("r")).groupBy("d", "k").agg(F.collect_list("r").alias("runs"))
    wanted, wanted_path = common.written(wanted, "wanted")
    texts, texts_path = common.written(run_texts(docs, wanted, length), "run-texts")
    found, found_path = common.written(solved(texts, length), "solved")
    common.drop(spark, wanted_path, texts_path, groups_path)
    hits, hits_path = common.written(merged(found.filter("part >= 0").select("fp", "part", "windows", "low", "hashes", "own")), "merged")
    bits = found.filter("part = -1").select("fp", "run", "windows").union(merged_rows(hits))
    single = kinds.select("fp", "run", "n").join(bits, ["fp", "run"], "left").select("fp", "run", "n", "windows").filter("n > 1 OR windows IS NOT NULL")
    single, single_path = common.written(single, "verdicts")
    spans = intervals(rows.join(single, ["fp", "run"]), length)
    spans, spans_path = common.written(spans, "spans")
    common.drop(spark, kinds_path, found_path, hits_path, rows_path, single_path)
    out, _ = common.written(spans.groupBy("d", "k").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "removed")
    common.drop(spark, spans_path)
    return out


def joined_up(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def covered(df: DataFrame, length: int = 200) -> DataFrame:
    """Of each row of df: _row, its columns but the text; _text; _spans (a, b), the bytes of it that repeated strings cover, which may overlap (null: none).

    The text is carried once, as rows are sorted and sent to Python whole.
    """
    docs = df.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("doc_id", "text").alias("k"), "text")
    removed = find_repeats(docs, length)
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != "text"]
    whole = df.select(F.struct(*rest).alias("_row"), F.col("text").alias("_text"), F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("doc_id", "text").alias("k"))
    common.small_batches(df.sparkSession)
    return whole.join(removed, ["d", "k"], "left").select("_row", "_text", F.col("spans").alias("_spans"))


def without_repeats(df: DataFrame, length: int = 200) -> DataFrame:
    """df with n_bytes, n_removed, n_spans, spans (start and end of the removed runs of bytes) and kept_bytes (the rest, joined) of each row's text.

    Removed is each byte that a string of `length` bytes covers which also starts anywhere else, in the same text or another (repeated rows are other
    texts, so equal texts of that length lose all). A null or empty text, or one shorter than `length`, loses nothing. Texts are taken
    whole. Other columns stay; columns of df named as the new ones are replaced.
    """
    new = ("n_bytes", "n_removed", "n_spans", "spans", "kept_bytes")
    df = df.drop(*new)
    joined = covered(df, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in new}
            for text, spans in zip(common.texts(batch.column("_text")), batch.column("_spans").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                runs = joined_up([(s["a"], s["b"]) for s in spans or ()])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                kept = b"".join(kept)
                for c, x in zip(new, (len(data), len(data) - len(kept), len(runs), [{"start": a, "end": b} for a, b in runs], kept)):
                    columns[c].append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), *(pa.array(columns[c], k) for c, k in zip(new, kinds))], names=["_row", "_text", *new])

    schema = common.schema_with(joined.select("_row", "_text"), "n_bytes long, n_removed long, n_spans long, spans array<struct<start: bigint, end: bigint>>, kept_bytes binary")
    return joined.mapInArrow(run, schema).select(*((F.col("_text") if c == "text" else F.col("_row")[c]).alias(c) for c in df.columns), *new)


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
