"""Files of other formats: CSV with a byte order mark, gzip, JSON lines, XML, lines of JSON entries, reports, and pinned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, bom: bool = False, compression: str = "none") -> None:
    """CSV with a header; with ``bom`` the header starts with the mark that spreadsheets look for. Times are written in UTC with their offset."""
    out = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    out.write.option("header", True).option("compression", compression).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are strings, and a byte order mark is no part of the first name."""
    if schema:
        return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.replace(BOM, "") for c in df.columns])


def write_xml(df: DataFrame, path: str, row: str = "row") -> None:
    df.write.format("xml").option("rowTag", row).option("rootTag", "rows").save(path)


def read_xml(spark: SparkSession, path: str, schema: str, row: str = "row") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def read_entries(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) of text files with one JSON entry a line, a map of one key; lines that aren't are left out."""
    lines = spark.read.text(path).select(F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e"))
    return lines.select(F.col("e.key").alias(key), F.col("e.value").alias(value))


def any_contains(df: DataFrame, text: str) -> Column:
    """Whether any string column holds a text."""
    out = F.lit(False)
    for name, kind in df.dtypes:
        if kind == "string":
            out = out | F.coalesce(F.contains(F.col(name), F.lit(text)), F.lit(False))
    return out


def find_columns(columns: list[str], candidates: list[str], keywords: list[str]) -> list[str]:
    """The first candidate that is there, or else all columns that hold a keyword, in order; names compare without case."""
    lower = {c.lower(): c for c in columns}
    for c in candidates:
        if c.lower() in lower:
            return [lower[c.lower()]]
    return [c for c in columns if any(k.lower() in c.lower() for k in keywords)]


def publish(df: DataFrame, path: str, version: int) -> None:
    """Write a version of a table and then name it in the manifest, so that readers see whole versions only."""
    df.write.parquet(f"{path}/version={version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{path}/manifest")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version; a later one doesn't change what this reads."""
    newest = spark.read.schema("version int").json(f"{path}/manifest").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={newest}")
