"""Reports as files: a CSV with a byte order mark and a Markdown table for each result, and a manifest that is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "name string, kind string, rows long, columns long, digest string"


def lines_of(df: DataFrame, kind: str) -> DataFrame:
    """(i, line) of a result in the order of its columns; a report is small by its nature, so one task numbers its lines."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    quoted = [F.when(F.regexp_like(c, F.lit("[\",\n]")), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    body = F.concat_ws(",", *quoted) if kind == "csv" else F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = [",".join(df.columns)] if kind == "csv" else ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = df.select((F.row_number().over(Window.orderBy(*df.columns)) + len(head) - 1).cast("int").alias("i"), body.alias("line"))
    return df.sparkSession.createDataFrame(list(enumerate(head)), "i int, line string").union(rows)


def write_report(spark: SparkSession, folder: str, results: dict[str, DataFrame]) -> DataFrame:
    """Writes every result twice and returns the manifest as it was read again: name, kind, rows, columns and the md5 of the lines.

    Files are text in one part; the CSV begins with a byte order mark. Readers that wait for the manifest never meet half a report.
    """
    made = None
    for name, df in results.items():
        for kind in ("csv", "md"):
            lines = lines_of(df, kind)
            mark = F.when(F.col("i") == 0, "﻿").otherwise("") if kind == "csv" else F.lit("")
            lines.orderBy("i").select(F.concat(mark, "line").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.{kind}")
            back = spark.read.text(f"{folder}/{name}.{kind}").select(F.regexp_replace("value", "^﻿", "").alias("line"))
            digest = F.md5(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"))
            one = back.agg((F.count("*") - (1 if kind == "csv" else 2)).alias("rows"), digest.alias("digest")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "digest")
            made = one if made is None else made.union(one)
    made.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")
