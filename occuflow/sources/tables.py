"""Reading the tables, and the occupancy view of the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lot, ts, event_id, park, cells): a user's event is a poll of a lot of 100 cells; values over 100 are over capacity."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("lot"), "ts", "event_id", F.floor("value").cast("long").alias("park"), F.lit(100).cast("long").alias("cells"))


#: The same as SQL.
OBS = "obs AS (SELECT user_id AS lot, ts, event_id, CAST(floor(value) AS BIGINT) AS park, CAST(100 AS BIGINT) AS cells FROM events)"


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lot, name, lat, lng, cells, grade, kind, price): suppliers laid out on a plane of about 40 by 40 km."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("lot"), F.col("s_name").alias("name"), ((37_200 + F.pmod(k * 37, F.lit(401))) / 1000).alias("lat"), ((126_800 + F.pmod(k * 91, F.lit(397))) / 1000).alias("lng"),
        (20 + F.pmod(k * 13, F.lit(180))).alias("cells"), (1 + F.pmod(k, F.lit(5))).cast("int").alias("grade"), F.when(k % 3 == 0, "on").otherwise("off").alias("kind"), F.col("s_acctbal").alias("price"),
    )


LOTS = (
    "lots AS (SELECT s_suppkey AS lot, s_name AS name, 37.2 + (s_suppkey * 37 % 401) * 0.001 AS lat, 126.8 + (s_suppkey * 91 % 397) * 0.001 AS lng, "
    "20 + s_suppkey * 13 % 180 AS cells, CAST(1 + s_suppkey % 5 AS INTEGER) AS grade, CASE WHEN s_suppkey % 3 = 0 THEN 'on' ELSE 'off' END AS kind, s_acctbal AS price FROM supplier)"
)
