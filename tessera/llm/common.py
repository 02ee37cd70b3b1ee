"""What the operators of this subpackage share: tables, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one Arrow batch carries to Python; texts can be long, so far fewer than Spark's default.
BATCH_ROWS = 256

#: Gives memory that is free back to the system, where the C library can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the whole table, whatever other columns it has."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once. The setting stays with the session, as plans are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one where none is set and there is one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Writes df to shared storage and reads it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    free(spark)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished stages now, not when the driver next runs short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_caches: dict[str, dict] = {}


def cache_of(operator: str) -> dict:
    """What this Python worker keeps between the tasks of an operator. Workers outlive stages: what other operators have kept goes, and the memory with it."""
    if operator not in _caches:
        _caches.clear()
        _caches[operator] = {}
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
    return _caches[operator]


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """mapInArrow of a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def schema_with(df: DataFrame, extra: str) -> T.StructType:
    """The columns of df, whatever their names, and those of a DDL string."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + T.StructType.fromDDL(extra).fields)


def texts(column: pa.Array) -> list[str]:
    """Nulls as empty texts."""
    return [x or "" for x in column.to_pylist()]


def crc_bucket(doc_id, n: int):
    """crc32 of doc_id as text, modulo n. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
