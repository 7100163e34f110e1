"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


# Rows whose texts are Python objects at a time.
SLICE_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine that names none gets one below its warehouse, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(df: DataFrame, most: int, name: str) -> list[dict]:
    """The rows of ``df`` on the driver, after they were counted to be at most ``most``."""
    kept = written(df, name)
    rows = kept.count()
    if rows > most:
        raise ValueError(f"{name} has {rows} rows, at most {most} were expected")
    return kept.toArrow().to_pylist()


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like ``written``, in hash buckets of ``key``: a join or grouping by it into as many
    partitions moves none of these rows again."""
    spark, unique = df.sparkSession, f"{name}_{uuid4().hex}"
    to = df.write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{unique}")
    to.bucketBy(buckets, key).format("parquet").saveAsTable(unique)
    frame = spark.table(unique)
    # The frame knows its files by now; they stay when the name goes.
    spark.sql(f"DROP TABLE {unique}")
    return frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_arrow_columns(
    df: DataFrame, text: str, fields: str, compute: Callable[[list[bytes]], list], drop: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` and new columns that ``compute`` derives from the UTF-8 bytes of ``text`` (null: None).

    ``compute`` gets the texts of one Arrow batch and returns one list or Arrow array per
    field. Input columns in ``drop``, or with a new column's name, are left out.
    """
    added = StructType.fromDDL(fields)
    kept = [c for c in df.columns if c not in added.names and c not in drop]
    columns = [F.col(_quoted(c)) for c in kept]
    if text in kept:
        at = kept.index(text)  # a text that stays is sent once
    else:
        at = len(kept)
        columns.append(F.col(_quoted(text)).alias(_free_name("_text", df.columns)))
    source = df.select(*columns)
    schema = StructType([*source.schema.fields[: len(kept)], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema).types
        for part in slices(batches):
            new = compute(part.column(at).cast(pa.binary()).to_pylist())
            arrays = [part.column(i) for i in range(len(kept))]
            arrays += [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(new, kinds[len(kept):])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, ``SLICE_ROWS`` at a time; frees memory after the last."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
    release_memory()


def release_memory() -> None:
    """Give freed memory back: a worker lives on, and other tasks' workers share its machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col(_quoted(name))


def _free_name(stem: str, taken: list[str]) -> str:
    lower = {c.lower() for c in taken}
    while stem.lower() in lower:
        stem += "_"
    return stem


def free_name(stem: str, df: DataFrame) -> str:
    """``stem``, longer by underscores if ``df`` has a column of that name."""
    return _free_name(stem, df.columns)


def decoded(text: bytes | None) -> str:
    """The text of UTF-8 bytes; null is empty, invalid bytes become U+FFFD."""
    return "" if text is None else text.decode("utf-8", "replace")
