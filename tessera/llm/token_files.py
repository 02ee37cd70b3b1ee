"""Token ids of documents in Parquet files that allow selective reads.

A file holds its documents in ascending doc_id order, one row each: `doc_id`, `part` and `part_start` (the file, and the ids before the
document within it), `n_tokens`, and `tokens`, a list of 32-bit ids. Ids are stored with dictionary encoding (few distinct ids
in a row group: the pages hold bit-packed indexes) or, on request, with delta encoding (format v2). Row groups have a set size, and pages
a set number of rows; the page index (minima, maxima and offsets of pages) lets a reader of a range of doc_id touch only its pages,
and a reader of metadata never touches ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common, subwords

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
    ]
)

#: Characters that are encoded together in a task.
AT_ONCE = 500_000

#: Bytes of texts whose chunks are looked up together.
TOGETHER = 2 << 20

_encoders: dict = {}


def encoder(path: str) -> subwords.Kept:
    """Of this Python worker: chunk -> ids as little-endian 32-bit bytes."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _encoders[path] = subwords.Kept(subwords.row_encoder(tokenizer), marks=subwords.marks_of(path))
    return _encoders[path]


def encode_texts(found: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each ends."""
    ids, at = encoder(path).encode_all(found)
    ends = at[1:]
    return (ids, ends) if end_id is None else (np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1))


def pieces(batch: pa.RecordBatch, column: str = "text", at_once: int = AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in runs of rows of about at_once characters."""
    found = common.texts(batch.column(column))
    start = size = 0
    for k, text in enumerate(found):
        size += len(text)
        if size >= at_once or k == len(found) - 1:
            yield batch.slice(start, k + 1 - start), found[start : k + 1]
            start, size = k + 1, 0


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", at_once: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of about at_once bytes, so that what they have in common is looked up once."""
    waiting, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(int(np.searchsorted(ends, before + at_once - size)) + 1, batch.num_rows)
            waiting.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= at_once:
                yield pa.concat_batches(waiting) if len(waiting) > 1 else waiting[0]
                waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting) if len(waiting) > 1 else waiting[0]


def encoded(df: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Documents in ascending doc_id order with their ids, in the files' schema."""
    common.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for rows in runs(batches):
            ids, ends = encode_texts(rows.column("text"), tokenizer, end_id)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.full(len(ends), part, np.int32)),
                    pa.array(starts + before),
                    pa.array(ends - starts),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(ids.view("<i4"))),
                ],
                names=SCHEMA.names,
            )
            before += int(ends[-1])

    ordered = df.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, SCHEMA)


def write(
    df: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int | None = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 1000,
    page_bytes: int = 1 << 20,
) -> None:
    """Encodes `text` of df(doc_id, text) with a tokenizer file of the tokenizers library, appends end_id to each document (None: nothing), and
    writes the ids to path in ascending doc_id order.

    A null or empty text has the end id alone. A null doc_id sorts first. Rows that share a doc_id are all kept, ordered by a hash of their
    texts. Columns other than doc_id and text are ignored. An empty table gives files without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    options = {
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }
    encoded(df, tokenizer or subwords.default_path(), end_id).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Rows of the files, or those of a closed range of doc_id: the range reaches the row group statistics and the page index."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first_id is not None:
        df = df.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        df = df.filter(F.col("doc_id") <= last_id)
    return df


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """part, before: the ids in all files before this one. One row a file, from the metadata columns alone."""
    sums = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for part, n in sums:
        rows.append((part, before))
        before += n
    return spark.createDataFrame(rows, "part int, before long")


def read_with_start(spark: SparkSession, path: str) -> DataFrame:
    """Rows with start: the ids of all documents before this one. What is broadcast has one row for each file."""
    return read(spark, path).join(F.broadcast(offsets(spark, path)), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def with_crc32(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from rows with tokens."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("tokens")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        found = [zlib.crc32(np.ascontiguousarray(values[a:b])) for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", "start", "n_tokens")] + [pa.array(found, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    common.small_batches(df.sparkSession)
    return common.map_batches(df.select("doc_id", "start", "n_tokens", "tokens"), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    write(common.documents(spark, sf_dir), path, end_id=2)
    common.free(spark)
    return with_crc32(read_with_start(spark, path))
