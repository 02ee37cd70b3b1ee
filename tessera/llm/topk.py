"""Exact top-k search by integer inner product, with bounds from segment statistics at several resolutions.

A vector is cut into segments; of each, mean and deviation are kept. With m components a segment, the inner product of two segments is at most
m * (mean * mean + deviation * deviation), by Cauchy and Schwarz; the sum over segments bounds the inner product from above, and so the
distance from below. Coarse statistics drop most pairs, finer ones most of the rest, and only survivors get an exact product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Segments of the two resolutions, coarse and fine.
LEVELS = (4, 16)
#: Queries that one pass over the candidates takes; a block of them is what is broadcast.
QUERY_BLOCK = 8192
#: Candidates that are compared with a block at once hold about so many pairs.
PAIRS_AT_ONCE = 1 << 20


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(m) * (means, deviations): the product of two such rows bounds the product of the vectors."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:])]
    weight = np.sqrt([p.shape[1] for p in parts])
    return np.hstack([np.stack([p.mean(1) for p in parts], 1) * weight, np.stack([p.std(1) for p in parts], 1) * weight])


def whole(vectors: pa.Array) -> list[np.ndarray]:
    """floor(1024 * x) of each vector, as doubles (exact below 2**53)."""
    at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    scaled = np.floor(1024 * values.astype(np.float64))
    return [scaled[a:b] for a, b in zip(at[:-1], at[1:])]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, all rows of a with all of b, while they fit 64 bits."""
    reach = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * a.shape[1]
    if reach < 2**53:
        return (a @ b.T).astype(np.int64)
    most = float(2**62)
    return np.clip(a, -most, most).astype(np.int64) @ np.clip(b, -most, most).astype(np.int64).T


class Best:
    """The k best (score, smaller id first) candidates of each query of a block, and the bounds that leave most pairs out."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.q, self.ids, self.k = queries, query_ids, k
        n = len(queries)
        self.rows = np.zeros((0, 4), np.int64)  # query, score, id, own
        self.least = np.full(n, np.iinfo(np.int64).min)  # of the k-th best so far
        self.levels = [statistics(queries, s) for s in LEVELS if queries.shape[1] >= 4 * s]
        self.norm = np.sqrt((queries**2).sum(1))

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        full = self.least > np.iinfo(np.int64).min
        slack = 1e-9 * np.outer(self.norm, np.sqrt((x**2).sum(1))) + 1e-6 if self.levels and full.any() else None
        if slack is None:
            every = products(self.q, x)
            place = max(len(x) - self.k, 0)
            a, b = np.nonzero(every >= np.partition(every, place, axis=1)[:, place, None])
            score = every[a, b]
        else:
            least = np.where(full, self.least, -np.inf)[:, None]
            keep = self.levels[0] @ statistics(x, LEVELS[0]).T + slack >= least
            if len(self.levels) > 1:
                a, b = np.nonzero(keep)
                if len(a):
                    fine = np.einsum("ij,ij->i", self.levels[1][a], statistics(x, LEVELS[1])[b]) if len(a) < keep.size // 8 else (self.levels[1] @ statistics(x, LEVELS[1]).T)[a, b]
                    keep[a, b] = fine + slack[a, b] >= least[a, 0]
            a, b = np.nonzero(keep)
            if len(a) * 8 > keep.size:
                score = products(self.q, x)[a, b]
            else:
                score = np.zeros(len(a), np.int64)
                for s in range(0, len(a), 1 << 15):
                    u, v = self.q[a[s : s + (1 << 15)]], x[b[s : s + (1 << 15)]]
                    if max(np.abs(u).max(initial=0), 1) * max(np.abs(v).max(initial=0), 1) * u.shape[1] >= 2**53:
                        u, v = (np.clip(w, -(2.0**62), 2.0**62).astype(np.int64) for w in (u, v))
                    score[s : s + (1 << 15)] = np.einsum("ij,ij->i", u, v)
        good = score >= self.least[a]
        a, b, score = a[good], b[good], score[good]
        own = ids[b] == self.ids[a]
        own[own] = (self.q[a[own]] == x[b[own]]).all(1)
        self.rows = np.vstack([self.rows, np.stack([a, score, ids[b], own], 1)])
        self.cut()

    def cut(self) -> None:
        r = self.rows[np.lexsort((self.rows[:, 2], ~self.rows[:, 1], self.rows[:, 0]))]
        first = np.searchsorted(r[:, 0], r[:, 0])
        place = np.arange(len(r)) - first
        self.rows = r[place < self.k]
        last = r[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]


def usable(vector: str) -> Column:
    """No null, and no component that is null or not finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, good)


def top_k(df: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of the k rows with the highest integer inner product, for each row for which is_query holds.

    Candidates are all rows but the query's own; a second row equal to it is a candidate. Ties go to the smaller id. Vectors that are null,
    or hold a null or non-finite component, or whose id is null take no part. Vectors of another length than the query's aren't its
    candidates. Scores are exact within 64 bits. With fewer than k candidates all are returned; an empty table gives no rows.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    taken = df.filter(F.col(id).isNotNull() & usable(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    schema = "block int, query int, query_id long, vec_id long, score long, own int"
    queries = taken.filter("q").select("id", "v")
    blocks = max(1, common.ceil_div(queries.count(), QUERY_BLOCK * 3 // 4))  # blocks are hashed, so not all of one size
    found = None
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        query_ids = rows.column("id").to_numpy()
        order = np.argsort(query_ids, kind="stable")
        lists = whole(rows.column("v").chunk(0))
        held = spark.sparkContext.broadcast((query_ids[order], [lists[i] for i in order]))

        def run(batches: Iterator[pa.RecordBatch], held=held, block=block) -> Iterator[pa.RecordBatch]:
            ids, vectors = held.value
            lengths = np.array([len(v) for v in vectors])
            best = {n: (at := np.flatnonzero(lengths == n), Best(np.stack([vectors[i] for i in at]), ids[at], k + 1)) for n in set(lengths.tolist())}
            for batch in batches:
                if not batch.num_rows:
                    continue
                found_ids, found = batch.column("id").to_numpy(), whole(batch.column("v"))
                sizes = np.array([len(v) for v in found])
                for n, (at, b) in best.items():
                    here = np.flatnonzero(sizes == n)
                    step = max(64, PAIRS_AT_ONCE // len(at))
                    for s in range(0, len(here), step):
                        some = here[s : s + step]
                        b.add(np.stack([found[i] for i in some]).reshape(len(some), n), found_ids[some])
            for at, b in best.values():
                if len(b.rows):
                    q, score, vec, own = b.rows.T
                    n = len(q)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, block, np.int32)), pa.array(at[q].astype(np.int32)), pa.array(ids[at[q]]), pa.array(vec), pa.array(score), pa.array(own.astype(np.int32))],
                        names=["block", "query", "query_id", "vec_id", "score", "own"],
                    )

        part = taken.select("id", "v").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id} long, score long")
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    merged = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    # of the rows equal to the query one is the query itself
    own_before = F.sum("own").over(Window.partitionBy("block", "query").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    merged = merged.withColumn("nth", own_before).filter(~((F.col("own") == 1) & (F.col("nth") == 1)))
    rank = F.row_number().over(Window.partitionBy("block", "query").orderBy("place")).cast("int")
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id), "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
           FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
