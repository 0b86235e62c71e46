"""Helpers shared by the training-data operators: shared storage, written tables, tokenizer files.

Everything that more than one task has to see is written below the folder named by
``spark.checkpoint.dir``; nothing is left in a machine-local folder on a cluster.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: ``[\x20\x09-\x0D]``, the white space of every contract here; also what ``bytes.split()`` splits at.
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one (tests) gets its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; no two calls get the same one."""
    return f"{shared_dir(spark).rstrip('/')}/lexloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back: cuts lineage and survives the loss of executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def newest(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The last finished table of a folder whose name starts with a prefix, by name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return max((f.getPath().getParent().toString() for f in found), default=None)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI, and the path in it; ``file:/x`` is understood as well."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, text: str | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds ``rows`` rows, or about ``most`` bytes of one column."""
    try:
        for batch in batches:
            at = 0
            step = rows
            if text is not None and batch.num_rows:
                mean = batch.column(batch.schema.get_field_index(text)).nbytes / batch.num_rows
                step = max(1, min(rows, int(most / max(mean, 1))))
            while at < batch.num_rows:
                yield batch.slice(at, step)
                at += step
    finally:
        release()


def release() -> None:
    """Gives memory that a task has freed back to the system: workers are used again and would keep it beside the next task's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def tokenizer_file(name: str) -> bytes:
    """A file of the public tokenizers as bytes (at most a few MB), to be shipped with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
