"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to a Python worker, at most (Spark's own limit by rows knows nothing of long texts).
MAX_BATCH = 8 << 20
#: Bytes of a table that is broadcast, at most, a row counting ROW_BYTES more than its values.
MAX_BROADCAST = 32 << 20
ROW_BYTES = 16
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Make Python workers able to import this package, bound their batches, and name a checkpoint folder.

    The folder of ``spark.checkpoint.dir`` is used where the session has one; only a session on
    one machine (tests, a notebook) gets a folder of its own without it, and one on a cluster fails.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    sc = spark.sparkContext
    if sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > MAX_BATCH:
        spark.conf.set(_BATCH, MAX_BATCH)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read, as a URI."""
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have, upper and lower case aside."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def binaries(arr: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without building str objects."""
    kind = pa.large_binary() if pa.types.is_large_string(arr.type) else pa.binary()
    return arr.cast(kind).to_pylist()


def map_batches(
    df: DataFrame, cols: list[str], rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` over the named columns alone, one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch can hold thousands of very long texts: work on some megabytes at a time
            for part in slices(batch):
                out = rows(part)
                if out is not None and out.num_rows:
                    yield out

    return df.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes, whole rows always."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def broadcast_if_small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` marked for broadcast if the bytes of its rows, by ``size``, are counted to be at most
    ``MAX_BROADCAST``; as it is otherwise.  Give it a checkpointed or cheap frame: it is read for that."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return F.broadcast(df) if total + ROW_BYTES * n <= MAX_BROADCAST else df



def with_fields(schema, fields: list[tuple[str, str]]):
    """The schema with further nullable fields, types given as DDL."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    return StructType([*schema.fields, *(StructField(n, _parse_datatype_string(t)) for n, t in fields)])
