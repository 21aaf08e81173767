"""Shared scratch space of a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

_local_folders: dict[str, str] = {}
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or in local mode a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="folioloom-")
    return _local_folders[context.applicationId]


def new_table_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder, or below that of the `scratch` around; nothing there is ever reused or overwritten."""
    return f"{_scratch.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores inside are deleted at the end. What is to last must be written elsewhere before that."""
    folder = new_table_path(spark, "scratch")
    outer = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(outer)
        remove_table(spark, folder)


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, on whatever store that is."""
    def plain(name: str) -> str:
        return unquote(urlparse(name).path) if urlparse(name).scheme == "file" else name

    if not plain(path).startswith(plain(shared_folder(spark)).rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """Absolute path of a folder on the file system that driver and executors mount; None if Hadoop finds it on another store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(place).toUri().getPath() if store.getUri().getScheme() == "file" else None


def mounted_path(path: str) -> str:
    """Path that `open` understands, from a plain path or a `file:` URI; other schemes are not mounted folders."""
    scheme = urlparse(path).scheme
    if scheme == "file":
        return unquote(urlparse(path).path)
    if scheme and "://" in path:
        raise ValueError(f"{path}: file trees need a folder that all executors mount")
    return path
