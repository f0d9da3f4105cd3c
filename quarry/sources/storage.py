"""Looking at folders before reading them."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none when it does not exist."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder))


def read_if_present(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet below ``path``, or an empty frame of that schema."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_text(spark: SparkSession, path: str) -> str:
    files, name = _folder(spark, path)
    stream = files.open(name)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with all its content at once; False if it exists already.

    The content goes into a file of a name of its own that is then renamed without overwriting, the way
    streaming queries commit their logs. The rename is atomic on HDFS-like file systems.
    """
    context = spark.sparkContext
    files, name = _folder(spark, path)
    hadoop = context._jvm.org.apache.hadoop.fs
    files.mkdirs(name.getParent())
    draft = hadoop.Path(name.getParent(), f".{uuid.uuid4().hex}.draft")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    rename = context._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getField("NONE").get(None)
    options = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = rename
    try:
        hadoop.FileContext.getFileContext(draft.toUri(), context._jsc.hadoopConfiguration()).rename(draft, name, options)
        return True
    except Py4JJavaError as problem:
        if not files.exists(name):
            raise problem
        files.delete(draft, False)
        return False
