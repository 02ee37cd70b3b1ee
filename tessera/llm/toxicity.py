"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents; words get theirs from them: a word of a toxic document is toxic if it, or one of its beginnings, stands in far more toxic documents than
clean ones. The field (states clean and toxic; word, beginnings and end of a word as features) is fitted to these tags.
Its marginals give the offending spans, and their sum and maximum the score of the document, by logistic regression.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, textbytes
from tessera.llm.token_files import pieces

#: Labelled rows of each class that the classifier is fitted on, about, chosen evenly by a hash; fewer where there are fewer.
SAMPLE_PER_CLASS = 2500
#: Weights of the field, a table of fixed size.
TABLE = 1 << 18
#: Words of a training segment, and of a lane when documents are scored.
SEGMENT, LANE = 32, 128
#: A feature marks toxic words if it stands in so many toxic documents at least, and in so many times as large a part of them as of clean ones.
LEAST_DOCUMENTS, RATIO = 6, 15
KEPT_WORDS = 400_000
EDGE = 30.0

WORD = re.compile(r"[^\W_]+")


def marks(word: str) -> list[str]:
    """What may tell a toxic word: itself and its beginnings."""
    return [word] + [f"{word[:n]}~" for n in (3, 4, 5, 6) if len(word) > n]


def features(word: str) -> list[int]:
    """Places in the table of weights: the word, its beginnings, its end and its length."""
    data = word.encode()
    found = [data, b"~" + data[-4:], b"#%d" % min(len(data), 12)]
    found += [data[:n] + b"~" for n in (3, 4, 5, 6) if len(data) > n]
    return [zlib.crc32(x) & (TABLE - 1) for x in found]


@dataclass
class Field:
    weights: np.ndarray  # of toxic against clean
    step: np.ndarray  # (2, 2), from state to state, as logarithms
    start: np.ndarray  # (2,)
    top: np.ndarray  # of the document score

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of each word of documents in a row; first marks the words that begin one.

        Forward-backward in lanes: matrices of whole lanes are multiplied first, so that the states at their borders are known, then all lanes run at once.
        """
        n = len(e)
        lanes = common.ceil_div(n, LANE)
        size = lanes * LANE
        a = np.exp(self.step - self.step.max())
        s = np.exp(self.start - self.start.max())
        m = np.empty((size, 2, 2))
        m[:n] = a
        m[:n][first] = s
        m[n:] = 1.0
        m[:n, :, 1] *= np.exp(e)[:, None]
        m = m.reshape(lanes, LANE, 2, 2).transpose(1, 2, 3, 0)  # position, from, to, lane
        whole = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, lanes)).copy()
        for t in range(LANE):
            x = m[t]
            new = np.empty_like(whole)
            for i in (0, 1):
                for j in (0, 1):
                    new[i, j] = whole[i, 0] * x[0, j] + whole[i, 1] * x[1, j]
            new /= new.sum((0, 1))
            whole = new
        left, right = np.ones((2, lanes)), np.ones((2, lanes))
        state = np.array([0.5, 0.5])
        for k in range(lanes):
            left[:, k] = state
            state = state @ whole[:, :, k]
            state /= state.sum()
        state = np.array([0.5, 0.5])
        for k in range(lanes - 1, -1, -1):
            right[:, k] = state
            state = whole[:, :, k] @ state
            state /= state.sum()
        forward = np.empty((LANE, 2, lanes))
        f0, f1 = left
        for t in range(LANE):
            x = m[t]
            f0, f1 = f0 * x[0, 0] + f1 * x[1, 0], f0 * x[0, 1] + f1 * x[1, 1]
            total = f0 + f1
            f0, f1 = f0 / total, f1 / total
            forward[t, 0], forward[t, 1] = f0, f1
        out = np.empty((LANE, lanes))
        b0, b1 = right
        for t in range(LANE - 1, -1, -1):
            p1 = forward[t, 1] * b1
            out[t] = p1 / (forward[t, 0] * b0 + p1)
            x = m[t]
            b0, b1 = x[0, 0] * b0 + x[0, 1] * b1, x[1, 0] * b0 + x[1, 1] * b1
            total = b0 + b1
            b0, b1 = b0 / total, b1 / total
        return out.T.ravel()[:n]

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(total, most) @ self.top, -EDGE, EDGE)))


def summary(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Inputs of the document score from the sum and the maximum of its marginals."""
    return np.stack([np.log1p(total), most, np.ones_like(most)], 1)


class Emissions(dict):
    """word -> emission, worked out when first met."""

    def __init__(self, field: Field):
        super().__init__()
        self.weights = field.weights.tolist()

    def __missing__(self, word: str) -> float:
        weights = self.weights
        e = sum([weights[i] for i in features(word)])
        self[word] = e = min(max(e, -EDGE), EDGE)
        return e


def by_document(values: np.ndarray, sizes: np.ndarray, f: np.ufunc) -> np.ndarray:
    """f over the values of each document; 0 for documents without any."""
    out = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        out[some] = f.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def tagged(field: Field, emissions, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all words in a row, and the number of words of each text: lists of words with a dictionary of emissions, or arrays of numbers with an array."""
    sizes = np.array([len(w) for w in texts], np.int64)
    if isinstance(emissions, dict):
        e = np.array([e for words in texts for e in map(emissions.__getitem__, words)], np.float64)
    else:
        e = emissions[np.concatenate([*texts, np.zeros(0, np.int32)])]
    first = np.zeros(len(e), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return (field.marginals(e, first) if len(e) else e), sizes


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -EDGE, EDGE)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
    return w


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= 0.8 * (len(a) + len(b) - both)


def train(texts: list[str], toxic: list[int], share: tuple[float, float] = (1.0, 1.0), epochs: int = 2, seed: int = 0) -> Field:
    """From whole texts and their labels. share: the parts of the clean and the toxic rows that the sample holds, to undo its balance.

    All segments of all texts count. Near copies with one label (0.8 of their runs of three words in common, or more) count once, the first of them, where one of three minima finds them. Without
    rows of both classes the field finds nothing toxic (or everything, if all rows are toxic).
    """
    index: dict[str, int] = {}
    docs, labels = [], []
    seen: dict[tuple, np.ndarray] = {}
    for text, label in zip(texts, toxic):
        ids = np.array([index.setdefault(w, len(index)) for w in WORD.findall((text or "").lower())], np.int32)
        runs = np.unique(textbytes.windows(textbytes.mixed(ids.astype(np.uint64) + np.uint64(1)), np.array([len(ids)]), min(3, max(len(ids), 1)))[0]) if len(ids) else np.zeros(0, np.uint64)
        minima = [(label, k, int(textbytes.mixed(runs + np.uint64(k)).min()) if len(runs) else 0) for k in range(3)]
        if any(_alike(runs, other) for m in minima if (other := seen.get(m)) is not None):
            continue
        docs.append(ids)
        labels.append(label)
        for m in minima:
            seen.setdefault(m, runs)
    seen.clear()
    vocabulary = list(index)
    y = np.array(labels, np.float64)
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for ids, label in zip(docs, labels):
        counts[int(label)].update({m for w in np.unique(ids).tolist() for m in marks(vocabulary[w])})
    telling = {m for m, n in counts[1].items() if n >= LEAST_DOCUMENTS and n / n1 >= RATIO * (counts[0][m] + 0.5) / n0}
    tells = np.array([any(m in telling for m in marks(w)) for w in vocabulary], bool)
    table = np.full((max(len(vocabulary), 1), 7), TABLE, np.int32)
    for k, w in enumerate(vocabulary):
        found = features(w)
        table[k, : len(found)] = found
    del counts, telling, vocabulary, index
    rng = np.random.default_rng(seed)
    sizes = np.array([common.ceil_div(len(d), SEGMENT) for d in docs], np.int64)
    ids = np.full((int(sizes.sum()), SEGMENT), -1, np.int32)
    tags = np.zeros(ids.shape, np.int8)
    for row, d, label in zip((np.cumsum(sizes) - sizes).tolist(), docs, labels):
        flat = ids[row : row + common.ceil_div(len(d), SEGMENT)].reshape(-1)
        flat[: len(d)] = d
        if label and len(d):
            tags[row : row + common.ceil_div(len(d), SEGMENT)].reshape(-1)[: len(d)] = tells[d]
    weights, speed = np.zeros(TABLE + 1), np.full(TABLE + 1, 1e-3)
    trans, t_speed = np.zeros((3, 2)), np.full((3, 2), 1e-3)  # from clean, from toxic, at the start
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for s in range(0, len(order), 256):
            at = order[s : s + 256]
            i, z = ids[at], tags[at]
            real = i >= 0
            e = np.clip(weights[table[np.maximum(i, 0)]].sum(2), -EDGE, EDGE) * real
            # logarithms; past the end of a segment nothing is added
            alpha = np.empty((len(at), SEGMENT, 2))
            alpha[:, 0] = trans[2] + np.stack([np.zeros(len(at)), e[:, 0]], 1)
            for t in range(1, SEGMENT):
                x = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1])
                x[:, 1] += e[:, t]
                alpha[:, t] = np.where(real[:, t, None], x, alpha[:, t - 1])
            norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            beta = np.zeros((len(at), 2))
            g_e, g_t = np.zeros_like(e), np.zeros((3, 2))
            for t in range(SEGMENT - 1, -1, -1):
                live = real[:, t]
                p = np.exp(alpha[:, t] + beta - norm[:, None])
                g_e[:, t] = (p[:, 1] - z[:, t]) * live
                if t:
                    ahead = beta + np.stack([np.zeros(len(at)), e[:, t]], 1)
                    pair = np.exp(alpha[:, t - 1, :, None] + trans[:2] + ahead[:, None, :] - norm[:, None, None]) * live[:, None, None]
                    g_t[:2] += pair.sum(0)
                    np.add.at(g_t, (z[live, t - 1], z[live, t]), -1.0)
                    beta = np.where(live[:, None], np.logaddexp(trans[:2, 0] + ahead[:, :1], trans[:2, 1] + ahead[:, 1:]), beta)
                else:
                    g_t[2] += (p * live[:, None]).sum(0)
                    np.add.at(g_t, (np.full(live.sum(), 2), z[live, 0]), -1.0)
            g = np.bincount(table[i[real]].ravel(), np.repeat(g_e[real], table.shape[1]), minlength=TABLE + 1) / len(at)
            g += 1e-5 * weights * (g != 0)
            g[TABLE] = 0
            speed += g * g
            weights -= 0.3 * g / np.sqrt(speed) * (g != 0)
            g_t /= len(at)
            t_speed += g_t * g_t
            trans -= 0.1 * g_t / np.sqrt(t_speed)
    field = Field(weights[:TABLE].astype(np.float32), trans[:2], trans[2], np.zeros(3))
    by_word = np.clip(np.append(field.weights, 0.0)[table].sum(1), -EDGE, EDGE)
    p, sizes = tagged(field, by_word, docs)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    if len(y):
        field.top = logistic(summary(by_document(p, sizes, np.add), by_document(p, sizes, np.maximum)), y, weight / weight.mean())
    else:
        field.top = np.array([0.0, 0.0, -EDGE])
    return field


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Field:
    """From docs(doc_id, text) and labels(doc_id, toxic). Rows with a null doc_id, text or label don't count.

    The sample is bounded by per_class; its ids are the only thing broadcast, its texts the only ones that reach the driver.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = tuple(min(1.0, per_class / max(sizes.get(k, 0), 1)) for k in (0, 1))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) / 1_000_000
    chosen = known.filter(((F.col("toxic") == 0) & (spread < share[0])) | ((F.col("toxic") == 1) & (spread < share[1])))
    common.small_batches(spark)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toArrow()
    got = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), rows.column("toxic").to_pylist()))
    return train([r[1] for r in got], [r[2] for r in got], share)


def score(df: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """df with `score` (0 to 1, higher: toxic likelier) and, with spans, `toxic_spans`: start and end (in characters) of runs of
    words whose marginal is 0.5 or more, with the highest marginal.

    A null or empty text, or one without words, has the score of a text in which nothing is toxic, and no spans. Rows are independent, texts
    whole; columns of df named as the new ones are replaced, others stay.
    """
    spark = df.sparkSession
    df = df.drop("score", "toxic_spans")
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(field)
    kept: dict = {}
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.cache_of("toxicity")
        field = held.value
        emissions = kept.setdefault("emissions", Emissions(field))
        for batch in batches:
            for rows, found in pieces(batch) if batch.num_rows else ():
                lower = [t.lower() for t in found]
                p, sizes = tagged(field, emissions, [WORD.findall(t) for t in lower])
                most = by_document(p, sizes, np.maximum)
                columns = [*rows.columns, pa.array(field.score(by_document(p, sizes, np.add), most))]
                if spans:
                    ends = np.cumsum(sizes)
                    offending = [spans_of(t, p[b - n : b]) if m >= 0.5 else [] for t, m, b, n in zip(found, most, ends, sizes)]
                    columns.append(pa.array(offending, span_type))
                yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "score", *["toxic_spans"] * spans])
                if len(emissions) > KEPT_WORDS:
                    emissions.clear()

    return df.mapInArrow(run, common.schema_with(df, "score double" + ", toxic_spans array<struct<start: int, end: int, p: double>>" * spans))


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words with a marginal of 0.5 or more. Lower case may change a text's length: words are then found in the text itself."""
    words = [m.span() for m in WORD.finditer(text if len(text.lower()) == len(text) else text.lower())]
    out: list[dict] = []
    before = -2
    for k in np.flatnonzero(p >= 0.5):
        start, end = words[k]
        if k == before + 1:
            out[-1]["end"], out[-1]["p"] = end, max(out[-1]["p"], float(p[k]))
        else:
            out.append({"start": start, "end": end, "p": float(p[k])})
        before = k
    return out


def held_out(doc_id: Column) -> Column:
    return common.crc_bucket(doc_id, 5) == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = score(docs, fit(docs, labels.filter(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("toxic_spans").cast("long").alias("n_spans"))
