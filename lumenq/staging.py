"""Intermediate tables in the folder that all executors share: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all tasks run on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lumenq-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again; the files are removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: what was made from them has been written."""
    for table in tables:
        folders = {f.rsplit("/", 2)[1] for f in table.inputFiles()}
        for spark, path in [x for x in _STAGED if x[1].rsplit("/", 1)[1] in folders]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _STAGED.remove((spark, path))


@atexit.register
def _remove_all() -> None:
    for spark, path in _STAGED:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
