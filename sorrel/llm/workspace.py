"""Tables and files of a running job, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="sorrel-")
    return _FALLBACK[app]


class Workspace:
    """A folder of one operator call. Tables written here cut lineage, so a lost executor
    costs at most the step that was running."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/sorrel-{name}-{uuid.uuid4().hex[:12]}"

    def sub(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = self.sub(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table or folder that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.sub(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(file system, path) for tasks that read or write whole files at a shared URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class CommittedFile:
    """A file that appears under its name only when closed: a killed task leaves nothing that is read.

    The name holds a random part, so two attempts of a task never share a file; readers use
    the names in the table that the successful attempt returned.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.path = posixpath.join(path, self.name)
        self.stream = self.fs.open_output_stream(self.path + ".open")
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.stream.close()
        self.fs.move(self.path + ".open", self.path)
        return self.name


def open_input(folder: str, name: str):
    fs, path = filesystem(folder)
    return fs.open_input_file(posixpath.join(path, name))
