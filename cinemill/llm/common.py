"""Shared helpers of the text operators: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that setting is absent, a temporary folder stands in for it in local mode (tests); on a
    cluster, whose machines would not see it, that is an error.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        kept = sc._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not sc.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = kept.get() if kept.isDefined() else tempfile.mkdtemp(prefix="cinemill-")
        if not kept.isDefined():
            sc.setCheckpointDir(at)
    return at


def stage(df: DataFrame, label: str = "stage", parts: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there, and a lost
    executor costs no recomputation of what lies before it. With parts, in so many files at most."""
    spark = df.sparkSession
    df = df if parts is None else df.coalesce(parts)
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Have what is run in here hand over so many rows at once to Python; wide rows by the ten thousand take much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*staged: DataFrame) -> None:
    """Delete the files of tables made by stage() that no later action reads."""
    for df in staged:
        at = next((x.rpartition("/")[0] for x in df.inputFiles()), None)
        if at is None:
            continue
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(at))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of finished jobs' shuffle files now; Spark deletes them once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_CACHES: list = []


def on_drop(clear) -> None:
    """Have drop_caches() call this function in the present Python worker."""
    _CACHES.append(clear)


def drop_caches() -> None:
    """Let go of what earlier stages keep in a Python worker; Spark uses the worker again for later ones."""
    for clear in _CACHES:
        clear()


def doc_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table; null text counts as empty, other columns are left out."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions so that each holds about per_part rows."""
    return max(least, -(-int(rows) // per_part))
