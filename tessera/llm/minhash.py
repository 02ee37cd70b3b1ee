"""Near-duplicate documents: MinHash signatures in bands, links confirmed on whole sets, connected components.

Documents with equal sets of shingles form a class at once. Each class has 200 minima under universal hashes, in 40 bands of 5; of two sets
with a similarity of 0.8, 1 pair in 10**7 shares no band. Classes that share a bucket are candidates. They are compared in two steps:

1. Each class is held against one leader, the class of its buckets that meets most others. The components of the confirmed links leave few buckets
   with more than one component.
2. The classes of such buckets form groups, one for each component that leads buckets. Within a group only classes of different components are compared: the
   signatures first (8 bits of each of the 200 minima), then whole sets. A large group is dealt over a grid of cells, each a task's
   work of bounded size; a class is copied to a row or a column of cells, pairs never become rows.

So each pair that shares a band is either linked by a path already or compared. Signatures pass a pair if MATCHES of its minima agree or more, 4.5 standard
deviations below what is expected at 0.8: 1 pair in 250,000 at just 0.8 is lost there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, textbytes
from tessera.llm.components import components
from tessera.llm.token_files import pieces

BANDS, ROWS = 40, 5
#: Standard deviations by which the minima of a pair may agree less often than expected at the similarity asked for.
DEVIATIONS = 4.5
#: Classes that one task holds against a leader in a row; classes on each side of a cell.
SLOT, CELL = 256, 1024
#: Parts over which the partners of one hot key are dealt before they are joined with its size.
SALTS = 32

_rng = np.random.default_rng(20240613)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BAND_SEED = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_ROW_SEED = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of `size` words, A-Z lower-cased; of the whole sequence if it is shorter; none without words."""
    t = textbytes.Texts(texts, lower=True)
    start, end, counts = t.words()
    h = textbytes.span_hashes(t.data, start, end)
    first = np.cumsum(counts) - counts
    shingles, n = textbytes.windows(h, counts, size)
    out = []
    at = np.cumsum(n) - n
    for k in range(len(texts)):
        if n[k]:
            out.append(np.unique(shingles[at[k] : at[k] + n[k]]))
        elif counts[k]:
            whole, _ = textbytes.windows(h[first[k] : first[k] + counts[k]], counts[k : k + 1], int(counts[k]))
            out.append(textbytes.mixed(whole + np.uint64(counts[k])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = int(textbytes.mixed(s).sum(dtype=np.uint64))
    b = int(textbytes.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) ^ len(s)
    return a - (1 << 63), (b & (2**64 - 1)) - (1 << 63)


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        h = _A[:, None] * x[None, k : k + 1024]
        h += _B[:, None]
        np.minimum(best, h.min(1), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, apart from those of other bands."""
    rows = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return textbytes.mixed((textbytes.mixed(rows + _ROW_SEED) * _ROW_SEED).sum(2, dtype=np.uint64) ^ _BAND_SEED).view(np.int64)


def short_minima(sigs: np.ndarray) -> np.ndarray:
    """8 bits of each minimum; those of different minima agree with a chance of 1 in 256."""
    return ((sigs * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_matches(percent: int) -> int:
    """Minima that agree at least in signatures of sets that may be linked."""
    n, p = BANDS * ROWS, percent / 100 + (1 - percent / 100) / 256
    return max(0, int(n * p - DEVIATIONS * (n * p * (1 - p)) ** 0.5))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def keyed(docs: DataFrame) -> DataFrame:
    """d, k, text: what tells rows apart. Rows alike in both have one text."""
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("k"), "doc_id", "text")


def signed(docs: DataFrame, size: int) -> DataFrame:
    """d, k, doc_id, n_shingles, the set's hash, and for sets that are not empty the keys of its bands and 8 bits of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.cache_of("minhash")
        for batch in batches:
            for rows, found in pieces(batch) if batch.num_rows else ():
                sets = shingle_sets(found, size)
                sigs = np.stack([signature(s) for s in sets])
                hashes = [set_hash(s) for s in sets]
                empty = np.array([not len(s) for s in sets])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band_keys(sigs).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in ("d", "k", "doc_id")),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([h[0] for h in hashes], pa.int64()),
                        pa.array([h[1] for h in hashes], pa.int64()),
                        pa.array([None if e else x for e, x in zip(empty.tolist(), keys.to_pylist())], pa.list_(pa.int64())) if empty.any() else keys,
                        pa.array([None if e else x.tobytes() for e, x in zip(empty.tolist(), short_minima(sigs))], pa.binary()),
                    ],
                    names=["d", "k", "doc_id", "n_shingles", "h1", "h2", "bands", "minima"],
                )

    common.small_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "d long, k long, doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, minima binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cid, set of the classes in wanted(cid, d, k, h1, h2), made anew from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = np.array([c not in seen and not seen.add(c) for c in batch.column("cid").to_pylist()], bool)  # a repeated row says nothing new
            batch = batch.filter(pa.array(new))
            for rows, found in pieces(batch) if batch.num_rows else ():
                sets = shingle_sets(found, size)
                said = zip(rows.column("h1").to_pylist(), rows.column("h2").to_pylist())
                keep = [k for k, (s, h) in enumerate(zip(sets, said)) if set_hash(s) == h]
                if len(keep) < len(sets):
                    raise ValueError("a document's set has changed since it was signed")
                ends = np.cumsum([0] + [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([rows.column("cid"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))], names=["cid", "set"])

    common.small_batches(docs.sparkSession)
    found = keyed(docs).select("d", "k", "text").join(wanted, ["d", "k"]).select("cid", "h1", "h2", "text").mapInArrow(run, "cid long, set array<long>")
    return found.groupBy("cid").agg(F.first("set").alias("set"))


def with_size(df: DataFrame, key: str, item: str, more_than: int) -> DataFrame:
    """df with _n, the rows of its key, where there are more than more_than (else null). The rows of a hot key are dealt over SALTS parts before the join."""
    salt = F.pmod(F.xxhash64(item, F.lit(3)), F.lit(SALTS))
    hot = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > more_than)
    hot = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return df.withColumn("_salt", salt).join(hot, [key, "_salt"], "left").drop("_salt")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[tuple, pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """work on the rows of each key, which come in a row."""
    common.cache_of("minhash")
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            key = tuple(int(c[a]) for c in columns)
            if key != at and held:
                if (found := work(at, pa.Table.from_batches(held))) is not None:
                    yield found
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held and (found := work(at, pa.Table.from_batches(held))) is not None:
        yield found


def sets_of(t: pa.Table) -> list[np.ndarray]:
    column = t.column("set").combine_chunks()
    at, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def links_rows(u: list[int], v: list[int]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]) if u else None


def held_against_leaders(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that are linked, as (u, v). Sets meet at (a, slot): a leader with many partners has its set in several slots."""
    slot = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("_n", F.lit(1)) / SLOT)).cast("long")
    slotted, path = common.written(with_size(pairs, "a", "b", SLOT).select("a", "b", slot.alias("slot")), "pairs")
    roles = slotted.select("a", "slot", F.col("b").alias("cid"), F.lit(1).alias("role"))
    roles = roles.union(slotted.select("a", "slot", F.col("a").alias("cid"), F.lit(0).alias("role")).distinct())
    rows = roles.join(sets, "cid").repartition("a", "slot").sortWithinPartitions("a", "slot", "role")

    def work(key: tuple, t: pa.Table) -> pa.RecordBatch | None:
        found, ids = sets_of(t), t.column("cid").to_pylist()
        v = [c for c, s in zip(ids[1:], found[1:]) if linked(found[0], s, percent)]
        return links_rows([key[0]] * len(v), v)

    got, _ = common.written(rows.mapInArrow(lambda batches: grouped(batches, ["a", "slot"], work), "u long, v long"), "links")
    common.drop(pairs.sparkSession, path)
    return got


def cells(rest: DataFrame) -> DataFrame:
    """i, j, home and other for each row of rest(key, cid, component): cell (i, j) of its group holds the classes of the i-th block as home, and those of the j-th block of
    classes outside the group's own component as other. So each pair of different components meets."""
    sized = with_size(rest, "key", "cid", CELL).withColumnRenamed("_n", "_all")
    outside = rest.filter("component <> key").groupBy("key").agg(F.count("*").alias("_out")).filter(F.col("_out") > CELL)
    outside = outside.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sized = sized.withColumn("_salt", F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(SALTS))).join(outside, ["key", "_salt"], "left").drop("_salt")
    blocks = [F.ceil(F.coalesce(n, F.lit(1)) / CELL).cast("long") for n in ("_all", "_out")]
    sized = sized.select("key", "cid", "component", *(b.alias(c) for b, c in zip(blocks, ("ni", "nj"))), (F.col("component") != F.col("key")).alias("out"))
    sized = sized.withColumn("mi", F.pmod(F.xxhash64("cid", F.lit(5)), "ni")).withColumn("mj", F.pmod(F.xxhash64("cid", F.lit(6)), "nj"))
    as_home = F.expr("transform(sequence(0L, nj - 1), j -> struct(mi AS i, j AS j, true AS home, out AND j = mj AS other))")
    as_other = F.expr("CASE WHEN out THEN transform(filter(sequence(0L, ni - 1), i -> i <> mi), i -> struct(i AS i, mj AS j, false AS home, true AS other)) ELSE array() END")
    return sized.select("key", "cid", "component", F.explode(F.concat(as_home, as_other)).alias("cell")).select("key", "cell.i", "cell.j", "cid", "component", "cell.home", "cell.other")


def across(groups: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: linked classes of different components in groups(key, cid, component)."""
    spark = groups.sparkSession
    least = least_matches(percent)
    placed = cells(groups).join(classes.select("cid", "n_shingles", "minima"), "cid")
    names = ["key", "i", "j", "cid", "component", "home", "other", "n_shingles", "minima"]

    def may_link(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Rows that are home, each with the other rows that it may be linked with."""
        n, component, cid = (t.column(c).to_numpy() for c in ("n_shingles", "component", "cid"))
        minima = np.frombuffer(b"".join(t.column("minima").to_pylist()), np.uint8).reshape(len(n), -1)
        is_other = t.column("other").to_numpy()
        other = np.flatnonzero(is_other)
        held, sizes = minima[other], n[other]
        for x in np.flatnonzero(t.column("home").to_numpy()).tolist():
            fit = (component[other] != component[x]) & (100 * np.minimum(sizes, n[x]) >= percent * np.maximum(sizes, n[x]))
            if is_other[x]:
                fit &= cid[other] > cid[x]  # such a pair meets twice
            some = np.flatnonzero(fit)
            if len(some):
                some = some[(held[some] == minima[x]).sum(1) >= least]
                if len(some):
                    yield x, other[some]

    def flag(key: tuple, t: pa.Table) -> pa.RecordBatch | None:
        keep = np.zeros(len(t), bool)
        for x, some in may_link(t):
            keep[x] = True
            keep[some] = True
        return t.filter(pa.array(keep)).select(names).combine_chunks().to_batches()[0] if keep.any() else None

    def confirm(key: tuple, t: pa.Table) -> pa.RecordBatch | None:
        cid, component, found = t.column("cid").to_pylist(), t.column("component").to_pylist(), sets_of(t)
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while (above := up.get(c, c)) != c:
                c = above
            return c

        u, v = [], []
        for x, some in may_link(t):
            for y in some.tolist():
                a, b = root(component[x]), root(component[y])
                if a != b and linked(found[x], found[y], percent):
                    up[max(a, b)] = min(a, b)
                    u.append(cid[x])
                    v.append(cid[y])
        return links_rows(u, v)

    at = ["key", "i", "j"]
    kinds = "key long, i long, j long, cid long, component long, home boolean, other boolean, n_shingles long, minima binary"
    rows = placed.select(*names).repartition(*at).sortWithinPartitions(*at)
    flagged, path = common.written(rows.mapInArrow(lambda batches: grouped(batches, at, flag), kinds), "flagged")
    rows = flagged.join(sets, "cid").repartition(*at).sortWithinPartitions(*at)
    got, _ = common.written(rows.mapInArrow(lambda batches: grouped(batches, at, confirm), "u long, v long"), "links")
    common.drop(spark, path)
    return got


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the document's component) and kept for each row of df(doc_id, text).

    Linked are documents whose sets of `size`-word shingles have 100 * intersection >= percent * union. A text that is null, empty or without words has an
    empty set, is linked with nothing and is its own component. Texts are taken whole, however long. Repeated rows, and rows with equal sets, are linked; all rows with the
    component's doc_id are kept. A row with a null doc_id is a document too: its component is the least id that is not null, or null; it is kept if its component is null.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select("doc_id", "text")
    every, _ = common.written(signed(docs, size), "signed")
    some = every.filter("n_shingles > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.min("d").alias("d"), F.min_by("k", "d").alias("k"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "minima")))
    classes, classes_path = common.written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members, members_path = common.written(buckets.join(shared, "bucket").select("bucket", "cid", "n"), "members")
    degrees, degrees_path = common.written(members.groupBy("cid").agg(F.sum("n").alias("degree")), "degrees")
    placed, placed_path = common.written(members.select("bucket", "cid").join(degrees, "cid"), "placed")
    wanted = classes.select("cid", "d", "k", "h1", "h2").join(degrees.select("cid"), "cid")
    sets, sets_path = common.written(whole_sets(docs, wanted, size), "sets")
    leaders = placed.groupBy("bucket").agg(F.max_by("cid", "degree").alias("leader"), F.max("degree").alias("d"))
    first = placed.join(leaders, "bucket").groupBy("cid").agg(F.max_by("leader", "d").alias("a")).filter("a <> cid").select("a", F.col("cid").alias("b"))
    links = held_against_leaders(first, sets, percent)
    labels, labels_path = common.written(components(links).toDF("cid", "component"), "labels")
    known = placed.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known, known_path = common.written(known, "known")
    split = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by("component", "degree").alias("key")).filter("lo <> hi").select("bucket", "key")
    groups, groups_path = common.written(known.join(split, "bucket").select("key", "cid", "component").distinct(), "groups")
    common.drop(spark, members_path, placed_path, degrees_path, known_path)
    more = across(groups, classes, sets, percent)
    if more.head(1):
        labels, new_path = common.written(components(links.union(more)).toDF("cid", "component"), "labels")
        common.drop(spark, labels_path)
        labels_path = new_path
    common.drop(spark, groups_path, sets_path)
    placed = classes.select("cid", "h1", "h2", "doc_id").join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed, placed_path = common.written(placed, "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids, _ = common.written(placed.join(least, "component").select("h1", "h2", "component_id"), "ids")
    common.drop(spark, classes_path, labels_path, placed_path)
    joined = every.select("doc_id", "n_shingles", "h1", "h2").join(ids, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), size=2)
