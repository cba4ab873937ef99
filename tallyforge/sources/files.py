"""Folders that all executors share, and files that tasks read by byte ranges."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary folder if Spark runs on this machine alone
    (tests); on a cluster an error, as executors would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} it must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="tallyforge-")
        where = "file://" + local
        spark.conf.set("spark.checkpoint.dir", where)
        atexit.register(_remove, local)
    return where.rstrip("/")


def _remove(local: str) -> None:
    import shutil

    shutil.rmtree(local, ignore_errors=True)


def hadoop(spark: SparkSession, where: str):
    """Hadoop's file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_dir(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one, which goes when the application ends."""
    at = f"{shared_dir(spark)}/tallyforge-{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"
    fs, path = hadoop(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def remove(spark: SparkSession, where: str) -> None:
    fs, path = hadoop(spark, where)
    fs.delete(path, True)


def qualified(uri: str) -> str:
    """A local path as pyarrow names it."""
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def listing(spark: SparkSession, where: str) -> list[tuple[str, int]]:
    """Name and bytes of the file, or of the files in the folder and below it, by name; hidden ones (as Spark has it) left out."""
    fs, path = hadoop(spark, where)
    if not fs.exists(path):
        return []
    out, todo = [], [fs.getFileStatus(path)]
    while todo:
        at = todo.pop()
        if at.isDirectory():
            todo += [s for s in fs.listStatus(at.getPath()) if s.getPath().getName()[0] not in "._"]
        else:
            out.append((qualified(at.getPath().toUri().toString()), at.getLen()))
    return sorted(out)


def open_file(uri: str):
    """The file, for reads at any place (local, S3, and HDFS where its client library is there)."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)
