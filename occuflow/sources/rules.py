"""Rule files: CSV with a fixed header, read line by line so that issues can name their lines."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "line long, column string, code string"


def read_rules(spark: SparkSession, path: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): texts of the fields with ``line`` and ``extra``, and what is wrong with the file itself.

    A missing file, or a header that isn't exactly the fields, gives one issue and no rows. A byte order mark is passed over. Values may be quoted,
    but not hold line ends. Lines are counted through all parts that the file is read in.
    """
    schema = ", ".join(["line long", "extra boolean", *(f"`{f}` string" for f in fields)])
    empty = lambda kind: spark.createDataFrame([], kind)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return empty(schema), spark.createDataFrame([(0, "file", "file_not_found")], ISSUE)
    lines = spark.read.text(path).withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    counts = {r["part"]: r["count"] for r in lines.groupBy("part").count().collect()}  # a row a part of the file
    starts = dict(zip(sorted(counts), accumulate([0, *(counts[k] for k in sorted(counts))]), strict=False))
    start = F.element_at(F.create_map(*[F.lit(v) for kv in starts.items() for v in kv]), F.col("part")) if starts else F.lit(0)
    numbered = lines.select((start + F.col("nth") + 1).cast("long").alias("line"), F.regexp_replace("value", "^﻿", "").alias("value"))
    head = numbered.where("line = 1").first()
    if head is None or [c.strip() for c in head["value"].split(",")] != list(fields):
        return empty(schema), spark.createDataFrame([(1, "header", "invalid_header")], ISSUE)
    kinds = ", ".join([*(f"`{f}` string" for f in fields), "extra_ string"])
    row = numbered.where("line > 1 AND trim(value) <> ''").select("line", F.from_csv("value", kinds, {"escape": '"'}).alias("x"))
    return row.select("line", F.col("x.extra_").isNotNull().alias("extra"), *[F.col("x")[f].alias(f) for f in fields]), empty(ISSUE)
