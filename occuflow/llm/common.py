"""Helpers shared by the operators: staging in the cluster's shared folder, text and id expressions."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace between words, as a regular expression class.
SPACE = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def id_crc(c: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def words(text: Column) -> Column:
    """The lower-cased words of a text (null: none), split at ASCII whitespace."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE + "+"), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the driver ends.

    Where the setting is absent and all runs in this process (tests), a temporary folder stands in for it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), "occuflow-shared").as_uri()
    folder = f"{base.rstrip('/')}/occuflow-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage, survives lost executors."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def open_fs(uri: str):
    """pyarrow's file system and path for a folder that tasks read and write as plain files."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
