"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's spark.checkpoint.dir. Only a session on one machine may leave it
    unset and gets a local folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not (context.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints/veilwork"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Lists that take the folders of tables while they are cut (see ``collecting``).
_TAKERS: list[list[str]] = []


@contextmanager
def collecting(folders: list[str]) -> Iterator[None]:
    """While it holds, the folders of all tables that are cut are added to a list, for ``drop``."""
    _TAKERS.append(folders)
    try:
        yield
    finally:
        _TAKERS.remove(folders)


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Removes cut tables that nothing reads any more; the list is empty afterwards."""
    context = spark.sparkContext
    while folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, so that a lost executor can't make them be computed again differently.

    A Parquet table rather than ``checkpoint()``: the readers prune its columns and it takes a fraction of the disk. It goes
    when the application ends, or before that by ``drop``.
    """
    path = f"{checkpoint_dir(frame.sparkSession).rstrip('/')}/veilwork-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    context = frame.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    for taker in _TAKERS:
        taker.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most_bytes``; a longer text is a part of its own."""
    size = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    first, held = 0, 0
    for i, n in enumerate(size):
        if i > first and held + n > most_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def text_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each part of each batch with its texts; null counts as empty."""
    for batch in batches:
        for part in slices(batch, column, most_bytes):
            yield part, [x or "" for x in part.column(column).to_pylist()]
