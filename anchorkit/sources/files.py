"""File checks on whatever file system the path names."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _fs(spark, path)
    return bool(fs.exists(jpath))


def finished(spark: SparkSession, path: str) -> bool:
    """True when a completed write left its success marker."""
    return exists(spark, path.rstrip("/") + "/_SUCCESS")


def partition_folder(spark: SparkSession, path: str, column: str, value) -> str:
    """Folder of one partition value, escaped as Spark writes it."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, str(value))
    return f"{path.rstrip('/')}/{name}"


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def children(spark: SparkSession, path: str) -> dict[str, tuple[int, int, bool]]:
    """Length, time of change (milliseconds) and "is a folder" of what lies in a folder, by name; empty when it isn't there."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return {}
    return {s.getPath().getName(): (s.getLen(), s.getModificationTime(), s.isDirectory()) for s in fs.listStatus(jpath)}


def read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write or replace a small file."""
    fs, jpath = _fs(spark, path)
    stream = fs.create(jpath, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear whole under its name, by one rename; False when the name is taken."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    write_text(spark, draft, text)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(draft), hadoop.Path(path)
    context = hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(source, target, options)
        return True
    except Py4JJavaError as failed:
        if "FileAlreadyExists" not in str(failed.java_exception):
            raise
        drop_folder(spark, draft)
        return False
