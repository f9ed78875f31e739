"""Helpers that the training-data operators share: the shared folder, staged tables, row keys and text columns."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every contract of this subpackage means it.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of a few numbers that one file of a staged table takes, where their number is known.
ROWS_A_FILE = 25_000
#: Rows of a few numbers, about 40 bytes each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_STAGED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder if all tasks run on this machine, as in tests; on a cluster an error, since
    executors would write parts that nobody else sees.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lumenq-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the program ends, or sooner by discard or scratch."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: what was made from them has been written."""
    for table in tables:
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            for i, (spark, path) in enumerate(_STAGED):
                if path.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]:
                    remove(spark, path)
                    del _STAGED[i]
                    break


@contextlib.contextmanager
def scratch():
    """Tables staged inside are removed at the end; results must have been written by then."""
    before = len(_STAGED)
    try:
        yield
    finally:
        for spark, path in _STAGED[before:]:
            remove(spark, path)
        del _STAGED[before:]


@atexit.register
def _remove_all() -> None:
    for spark, path in _STAGED:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            remove(spark, path)


def staged(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and lost executors lose nothing.

    rows: at most so many rows are expected; a small table is then written to few files, whatever the shuffle's width.
    """
    spark = df.sparkSession
    path = staged_path(spark, label)
    if rows is not None:
        df = df.coalesce(max(1, min(partitions_for(spark), -(-rows // ROWS_A_FILE))))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """A fingerprint that tells rows of one id apart by their text; never used across ids."""
    return F.xxhash64(text_of(column))


def slices(batch: pa.RecordBatch, column: str, max_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about max_chars bytes of text each: Arrow batches count rows, not bytes."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > max_chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


#: Whole texts that are held at a time, by Spark's default and here: rows and bytes of an Arrow batch, which is held on
#: both sides of the pipe to Python, and rows of the Parquet reader.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "256"),
}


def modest_batches(spark: SparkSession) -> None:
    """Small batches of whole texts in the session, where Spark's defaults still hold: rows here are documents and pages.

    Results are computed when the caller writes them, so the settings have to stay; those that the caller made are kept.
    """
    for name, (default, modest) in BATCH_SETTINGS.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, modest)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow(table: DataFrame, rows: int) -> DataFrame:
    """A table of a few numbers a row, to be joined with texts: broadcast up to a bound, else hashed, so that no text is sorted."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("shuffle_hash")


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay by verdicts (doc_id, text_key, stays), a verdict for each row.

    Rows are told by id and text: of rows with equal id and equal text one stays, different texts under one id are
    judged apart, and a null id is an id like any other. Columns of docs may have any names. What goes is mostly little: it is broadcast up to a bound;
    beyond it the kept keys are the hashed side of a shuffled join.
    """
    taken = {c.lower() for c in docs.columns}
    own_id, own_key, own_text = (next(f"{name}_{k}" for k in range(len(taken) + 1) if f"{name}_{k}" not in taken) for name in ("verdict_id", "verdict_key", "whole_text"))
    keys = staged(verdicts.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), "stays", "n"), "verdicts")
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (text_key(text_col) == F.col(own_key))
    gone = keys.where("not stays").select(own_id, own_key)
    out = docs.join(narrow(gone, gone.count()), same, "left_anti")
    again = keys.where("stays and n > 1").select(own_id, own_key)
    repeats = again.count()
    if not repeats:
        return out
    again = narrow(again, repeats)
    folded = out.join(again, same, "left_semi").withColumns({own_text: F.sha2(text_of(text_col), 256)}).dropDuplicates([id_col, own_text]).drop(own_text)
    return out.join(again, same, "left_anti").unionByName(folded)
