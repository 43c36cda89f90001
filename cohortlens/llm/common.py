"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() and bytes.strip() see it: \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, dealt over all cores where its files have fewer splits than there are cores.

    A large table has more splits, and nothing is shuffled then.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a folder of the warehouse takes its place, in local mode only: on a cluster the warehouse
    may be a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of frames that materialise() has written and that nothing will read again."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Give freed memory back to the system: workers live on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_texts(df: DataFrame, fn: Callable[[list, list], dict], schema: str, block_bytes: int = 4 << 20) -> DataFrame:
    """Run fn(ids, texts) over blocks of rows of (doc_id, text) and return its columns.

    Rows are cut into blocks of about block_bytes of text, so that neither a batch of long texts nor its
    results are held at once. A null text reaches fn as an empty one. fn returns a dict of columns.
    """
    arrow = pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in _parse(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = texts.nbytes / max(1, len(texts))
            at = 0
            while at < len(ids):
                n = _block(texts, at, block_bytes, sizes)
                part = ["" if t is None else t for t in texts.slice(at, n).to_pylist()]
                out = fn(ids[at : at + n], part)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                at += n
        release()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _block(texts: pa.Array, at: int, limit: int, mean: float) -> int:
    """How many rows from at on hold about limit bytes; one at least."""
    n = max(1, min(len(texts) - at, int(limit / max(1.0, mean)) or 1))
    while n > 1 and texts.slice(at, n).nbytes > 2 * limit:
        n //= 2
    return n


def _parse(schema: str):
    from pyspark.sql import types as T

    return T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(),
    "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}
