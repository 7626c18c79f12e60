"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text

BATCH_ROWS = 1000
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one, on a single machine only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="codeloom-"))
    return _LOCAL[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. Texts go to Python in small batches from here on: one may hold a thousand long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.scratch_path = path
    return out


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Working names for ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        out[name] = next(n for k in range(len(taken) + 1) if (n := f"_{name}{k or ''}").lower() not in taken)
    return out


def merged_arrays(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], add: Callable, size: int, kind: str, wide: str, segments: int, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """One array of ``size`` numbers over all of ``df``: ``make`` gives a task's (``kind``), ``add`` joins two (``wide``). A segment is added
    up as its parts stream in, so memory depends on ``size`` only; ``finish`` maps a segment's sum to what the driver gets."""
    step = size // segments

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = make(batches)
        parts = [pa.compress(whole[k * step : (k + 1) * step].tobytes(), "zstd", asbytes=True) for k in range(segments)]
        yield pa.RecordBatch.from_arrays([pa.array(range(segments)), pa.array(parts, pa.binary())], ["segment", "part"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for k, x in sums.items():
                out = (finish(x) if finish else x).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([out], pa.binary())], ["segment", "part"])
            sums.clear()

        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k not in sums:
                    yield from done()
                    sums[k] = np.zeros(step, wide)
                sums[k] = add(sums[k], np.frombuffer(pa.decompress(blob.as_buffer(), step * np.dtype(kind).itemsize, "zstd"), kind)).astype(wide)
        yield from done()

    sent = df.mapInArrow(local, "segment long, part binary").repartition("segment").sortWithinPartitions("segment")
    last = (finish(np.zeros(1, wide)) if finish else np.zeros(1, wide)).dtype
    out = np.zeros((segments, step), last)
    for r in sent.mapInArrow(total, "segment long, part binary").toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["part"], last)
    return out.reshape(-1)


SKETCH_BITS = 16, 27  # of a sketch's places, at least and at most


def places_for(n: int) -> int:
    """The power of two that a sketch of ``n`` keys has places: 32 a key, within ``SKETCH_BITS``."""
    return min(max(SKETCH_BITS[0], (32 * max(n, 1) - 1).bit_length()), SKETCH_BITS[1])


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(hashes: DataFrame) -> np.ndarray:
    """A bit for each of the 64-bit hashes, in 16 MB at most whatever their number. What is not ``marked`` is not among them;
    the fuller the sketch, the more others are marked, which a join then leaves out."""
    bits = places_for(hashes.count())
    size = 1 << bits - 3

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        made = np.zeros(size, np.uint8)
        for b in batches:
            at = _places(b.column(0).to_numpy(), bits)
            np.bitwise_or.at(made, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return made

    return merged_arrays(hashes, mark, np.bitwise_or, size, "u1", "u1", 64)


def marked(sketched: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes, len(sketched).bit_length() + 2)
    return (sketched[at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0


def sifted(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``df`` without most of the rows that a join with ``keys`` would leave out: they are not sent through the join's shuffle."""
    name = fresh(df, "mark")["mark"]
    bits = df.sparkSession.sparkContext.broadcast(sketch(keys.select(F.xxhash64(*on).alias("h"))))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(name)
            yield batch.filter(pa.array(marked(bits.value, batch.column(at).to_numpy())))

    marked_rows = df.withColumn(name, F.xxhash64(*on))
    return marked_rows.mapInArrow(sift, marked_rows.schema).drop(name)


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder as a table of buckets by a column: groups of it need no shuffle when it is read.
    The catalog, which alone takes buckets, forgets the table once it is resolved; its files stay."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.option("compression", "zstd").option("path", path).bucketBy(min(buckets, 50_000), by).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def delete(*tables: DataFrame) -> None:
    """Remove tables that ``saved`` wrote and that no later read needs."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps (it acts when the driver's heap is collected), and return the memory
    that the driver's Python has freed."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    text.give_back()
