"""Mixing to target weights with soft membership.

A classifier fitted on a table of labels gives each document a distribution over domains. Documents get rates, how often each is to be seen,
so that the expected tokens of the domains match their targets: least squares with a pull towards a rate of 1, solved by projected gradient
steps. The residual has one number for each domain, so a step is one pass over (tokens, posteriors) that gives back a few numbers for each partition: the residual, and
the curvature that the step is scaled by. A document's rate follows from what the steps add up to; nothing else has to be kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common, textbytes
from tessera.llm.token_files import pieces

#: Labelled rows of each domain that the classifier is fitted on, about, chosen evenly by a hash.
SAMPLE_PER_DOMAIN = 2000
#: Buckets of hashed words.
BUCKETS = 1 << 13
#: Targets of the query: parts of all tokens.
TARGETS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}
#: The pull towards a rate of 1; what the condition of the minimum may be off by, as a part of all tokens; the passes after which it is an error to be further off.
PULL, NEAR, PASSES = 1e-4, 1e-8, 200


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of all texts, and how many words each has."""
    t = textbytes.Texts(texts, lower=True)
    start, end, counts = t.words()
    return (textbytes.span_hashes(t.data, start, end) >> np.uint64(64 - 13)).astype(np.int64), counts


@dataclass
class Classifier:
    """Softmax over the mean weight of a text's words."""

    domains: list[str]
    weights: np.ndarray  # (BUCKETS, domains)
    bias: np.ndarray

    def posteriors(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.stack([textbytes.sums(self.weights[buckets, k], counts) for k in range(len(self.domains))], 1)
        z = total / np.sqrt(np.maximum(counts, 1))[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[str], domain: list[str], domains: list[str], share: np.ndarray, rounds: int = 80) -> Classifier:
    """Multinomial logistic regression by gradient steps; share: the part of each domain's rows in the sample, to give back its size."""
    buckets, counts = hashed_words(texts)
    y = np.eye(len(domains))[[domains.index(d) for d in domain]]
    model = Classifier(domains, np.zeros((BUCKETS, len(domains))), np.log(np.maximum(y.sum(0), 1) / share))
    if not len(texts) or len(domains) < 2:
        return model
    weight = (y / share).sum(1)
    weight /= weight.sum()
    owner = textbytes.owners(counts)
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    moment, speed = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for step in range(1, rounds + 1):
        error = (model.posteriors(buckets, counts) - y) * weight[:, None]
        g = np.stack([np.bincount(buckets, (error[:, k] * scale)[owner], BUCKETS) for k in range(len(domains))], 1) + 1e-6 * model.weights
        moment = 0.9 * moment + 0.1 * g
        speed = 0.99 * speed + 0.01 * g * g
        model.weights -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
        model.bias -= 0.5 * error.sum(0)
    return model


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], per_domain: int = SAMPLE_PER_DOMAIN) -> Classifier:
    """From docs(doc_id, text) and labels(doc_id, domain); rows with nulls, or with a domain that isn't listed, don't count. Only the sample's ids are broadcast."""
    known = labels.select("doc_id", "domain").filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    sizes = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    share = np.array([min(1.0, per_domain / max(sizes.get(d, 0), 1)) for d in domains])
    spread = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) / 1_000_000
    chosen = F.lit(False)
    for d, part in zip(domains, share):
        chosen = chosen | ((F.col("domain") == d) & (spread < float(part)))
    common.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(known.filter(chosen)), "doc_id").select("doc_id", "text", "domain").toArrow()
    got = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), rows.column("domain").to_pylist()))
    return train([r[1] for r in got], [r[2] for r in got], domains, share)


def posteriors(df: DataFrame, model: Classifier, pushes: np.ndarray | None = None, least: float = 0.0) -> DataFrame:
    """df with n_tokens (words) and posterior (array, in the order of the domains); given pushes, with the rate too, in the same pass: each further pass of a task has a
    Python worker of its own, which outlives the stage. Columns so named are replaced."""
    new = "n_tokens long, posterior array<double>" + ("" if pushes is None else ", rate double")
    df = df.drop(*T.StructType.fromDDL(new).names)
    spark = df.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.cache_of("mixing")
        model = held.value
        for batch in batches:
            for rows, found in pieces(batch) if batch.num_rows else ():
                buckets, counts = hashed_words(found)
                p = model.posteriors(buckets, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                found = [pa.array(counts.astype(np.int64)), lists, *([] if pushes is None else [pa.array(rates(p, pushes, least))])]
                yield pa.RecordBatch.from_arrays([*rows.columns, *found], names=schema.names)

    schema = common.schema_with(df, new)
    return df.mapInArrow(run, schema)


def rates(p: np.ndarray, pushes: np.ndarray, least: float) -> np.ndarray:
    """Rates after steps that add up to pushes: how far a token of each domain is pushed down, projected onto those of least or more."""
    return np.maximum(least, 1 - p @ pushes)


def batch_posteriors(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("posterior")
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def solve(table: DataFrame, targets: np.ndarray, least: float = 0.0, budget: float | None = None) -> np.ndarray:
    """What the steps add up to, from which rates follow. table(n_tokens, posterior) is read once for each step; budget: all tokens wanted (None: as many as
    there are, or, where rates have a least value, the fewest that allow the targets).

    At the minimum the steps so far are the residual over PULL; the passes end when both sides agree to NEAR of all tokens. The step is the residual over
    the curvature along the rates that aren't at their least value, and is halved while it doesn't bring the sides closer.
    """
    width = len(targets)
    low = [(i, j) for i in range(width) for j in range(i + 1)]

    def total(pushes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain at the rates, and the curvature."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width + len(low))
            for batch in batches:
                if batch.num_rows:
                    p, n = batch_posteriors(batch), batch.column("n_tokens").to_numpy()
                    r = rates(p, pushes, least)
                    free = n * (1 - p @ pushes > least)
                    sums += np.concatenate([(n * r) @ p, [(free * p[:, i]) @ p[:, j] for i, j in low]])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=[f"s{k}" for k in range(len(sums))])

        names = [f"s{k}" for k in range(width + len(low))]
        parts = table.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"{c} double" for c in names))
        found = np.nan_to_num(np.array(parts.agg(*(F.sum(c).alias(c) for c in names)).first(), dtype=float))
        curve = np.zeros((width, width))
        for (i, j), x in zip(low, found[width:]):
            curve[i, j] = curve[j, i] = x
        return found[:width], curve

    pushes = np.zeros(width)
    at, curve = total(pushes)
    base = at.sum()
    if base <= 0:
        return pushes
    if budget is None:
        budget = max(base, (at[targets > 0] / targets[targets > 0]).max()) if least >= 1 else base
    gap = (at - targets * budget) / base - PULL * pushes
    step, part = None, 1.0
    for _ in range(PASSES):
        if np.abs(gap).max() <= NEAR:
            return pushes
        if step is None:
            step = np.linalg.solve(curve / base + PULL * np.eye(width), gap)
        at, new_curve = total(pushes + part * step)
        new = (at - targets * budget) / base - PULL * (pushes + part * step)
        if np.linalg.norm(new) < (1 - part / 10) * np.linalg.norm(gap):
            pushes, gap, curve, step, part = pushes + part * step, new, new_curve, None, 1.0
        else:
            part /= 2
    raise RuntimeError(f"mixing: the rates' condition is still off by {np.abs(gap).max():.2g} of all tokens after {PASSES} passes")


def with_rates(table: DataFrame, pushes: np.ndarray, least: float = 0.0) -> DataFrame:
    """table with its rates; a column so named is replaced."""
    table = table.drop("rate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(batch_posteriors(batch), pushes, least))], names=[*batch.schema.names, "rate"])

    return table.mapInArrow(run, common.schema_with(table, "rate double"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], least: float = 0.0) -> DataFrame:
    """doc_id, n_tokens (words), posterior and rate (least or more) for each row of docs(doc_id, text).

    labels(doc_id, domain) says which domains documents belong to; targets the parts of all tokens (they are scaled to a sum of 1). A null or empty
    text has no tokens: it gets the domains' shares as its posterior, and the rate that goes with it. Repeated rows get the same rate. Without any
    label all posteriors are even; without any row there is no result. Texts are taken whole, however long. Domains without labelled rows stay in the model with hardly any weight.
    Extra columns are ignored.
    """
    names = list(targets)
    goal = np.array([targets[n] for n in names], float)
    model = fit(docs, labels, names)
    table, _ = common.written(posteriors(docs.select("doc_id", "text"), model).drop("text"), "posteriors")
    return with_rates(table, solve(table, goal / goal.sum(), least), least)


def label_domain() -> Column:
    """The domain of a row of labels(quality, toxic)."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels").select("doc_id", label_domain().alias("domain"))
    found = mix(common.documents(spark, sf_dir), labels, TARGETS)
    return found.select("doc_id", "n_tokens", *(F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(TARGETS)), "rate")
