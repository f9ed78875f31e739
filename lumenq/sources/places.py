"""Small documents and file listings, on this machine's disk or wherever Spark's file systems reach (scheme://...)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def is_remote(path: str) -> bool:
    return "://" in str(path) and not str(path).startswith("file:")


def _local(path: str) -> Path:
    return Path(str(path).removeprefix("file://"))


def _at(path: str):
    """(path, its file system) by Hadoop's interface."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a Spark session")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    if not is_remote(path):
        return _local(path).exists()
    where, fs = _at(path)
    return fs.exists(where)


def read_text(path: str) -> str:
    if not is_remote(path):
        return _local(path).read_text()
    row = SparkSession.getActiveSession().read.text(path, wholetext=True).head()
    return row[0] if row else ""


def write_text(path: str, text: str) -> None:
    """A whole document; folders above it are made."""
    if not is_remote(path):
        _local(path).parent.mkdir(parents=True, exist_ok=True)
        _local(path).write_text(text)
        return
    where, fs = _at(path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def walk(root: str) -> Iterator[str]:
    """All files at or below root; none where there is nothing."""
    if not is_remote(root):
        top = _local(root)
        yield from (str(p) for p in ([top] if top.is_file() else top.rglob("*") if top.exists() else []) if p.is_file())
        return
    where, fs = _at(root)
    if fs.exists(where):
        listing = fs.listFiles(where, True)
        while listing.hasNext():
            yield listing.next().getPath().toString()


def resolved(path: str) -> str:
    return path.rstrip("/") if is_remote(path) else str(_local(path).resolve())


def above(path: str) -> list[str]:
    """path and the folders above it, nearest first."""
    if not is_remote(path):
        return [str(path), *map(str, _local(path).resolve().parents)]
    scheme, rest = path.rstrip("/").split("://", 1)
    parts = rest.split("/")
    return [f"{scheme}://{'/'.join(parts[:n])}" for n in range(len(parts), 0, -1)]
