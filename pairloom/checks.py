"""Contract checks and bounded helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows a side may have before it is no longer shipped whole to every executor.
BROADCAST_ROWS = 1_000_000
# Text bytes it may hold, as rows alone do not bound the length of a string.
BROADCAST_BYTES = 64 * 1024 * 1024
# Spark's switch that removes the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or name every column it lacks."""
    absent = [name for name in dict.fromkeys(required) if name not in df.columns]
    if absent:
        raise ValueError(f"Missing required columns: {', '.join(sorted(absent))}")
    return df


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is within both bounds; counted map-side, so no rows move."""
    texts = [F.octet_length(name) for name, kind in df.dtypes if kind == "string"]
    size = sum((F.coalesce(text, F.lit(0)) for text in texts), F.lit(0)).cast("bigint")
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
    return seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names.

    A session on one machine that names none gets one below its warehouse, which all of its
    tasks reach; a cluster must name it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            require(context.master.startswith("local["), "spark.checkpoint.dir must name a shared folder on a cluster")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a small or medium frame in the shared folder so later jobs reuse it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``write_through`` made and nothing reads any more."""
    spark = table.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if folder is not None and folder.getName().startswith("table-"):
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def write_through(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write a large frame to a table in the shared folder and read it from there.

    Compared with a checkpoint the table is compressed, and readers fetch only the
    columns they use. With ``drop_shuffles`` what was shuffled for it leaves the disk once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    try:
        if drop_shuffles:
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
