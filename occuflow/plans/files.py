"""Round trips through other file formats, exports, reports and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import files
from ..sources.tables import read
from ..streaming.windows import work_folder

EVENTS = "SELECT event_id, ts, user_id, event_type, value FROM events"
COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def csv_with_bom(spark, d):
    """A CSV file that starts with a byte order mark, read with all columns as strings."""
    path = f"{work_folder(spark)}/bom"
    files.write_csv(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, bom=True)
    return files.read_csv(spark, path)


@query(EVENTS)
def gzip_csv(spark, d):
    """Predictions as gzipped CSV; times keep their microseconds."""
    path = f"{work_folder(spark)}/gzip"
    files.write_csv(read(spark, d, "events").select(*COLUMNS), path, compression="gzip")
    return files.read_csv(spark, path, SCHEMA)


@query(EVENTS)
def jsonl_scan(spark, d):
    path = f"{work_folder(spark)}/jsonl"
    read(spark, d, "events").select(*COLUMNS).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return spark.read.schema(SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_name LIKE '%7%'")
def xml_search(spark, d):
    """Rows of an XML file of which any string column holds a text."""
    path = f"{work_folder(spark)}/xml"
    files.write_xml(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, "lot")
    rows = files.read_xml(spark, path, "s_suppkey long, s_name string, s_nationkey int", "lot")
    return rows.where(files.any_contains(rows, "7"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer")
def id_map_lines(spark, d):
    """A map of ids to names, one JSON entry a line."""
    path = f"{work_folder(spark)}/idmap"
    read(spark, d, "customer").select(F.to_json(F.create_map(F.col("c_custkey").cast("string"), "c_name")).alias("value")).write.text(path)
    return files.read_entries(spark, path, "id", "name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def parquet_partitions(spark, d):
    """A Parquet sink by partition, of which one partition is read."""
    path = f"{work_folder(spark)}/parts"
    read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema("o_orderkey long, o_custkey long, o_orderstatus string").parquet(path).where("o_orderstatus = 'O'")


@query("SELECT user_id, event_id, value FROM events WHERE event_type = 'view'")
def pinned_snapshot(spark, d):
    """A reader of the newest published version; what is published meanwhile, or half written, isn't seen."""
    path, e = f"{work_folder(spark)}/table", read(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    files.publish(e.where("event_type = 'click'").drop("event_type"), path, 1)
    files.publish(e.where("event_type = 'view'").drop("event_type"), path, 2)
    seen = files.snapshot(spark, path)
    e.where("event_type = 'error'").drop("event_type").write.parquet(f"{path}/version=3")
    return seen


@query("""SELECT l.s_suppkey AS lot, l.s_name AS name, count(*) AS n, count(DISTINCT CAST(floor(e.value) AS BIGINT)) AS uniq, min(e.value) AS lo, max(e.value) AS hi, round(CAST(sum(CAST(e.value AS DECIMAL(18, 2))) AS DOUBLE) / nullif(count(*) * any_value(l.s_nationkey), 0), 6) AS ratio
FROM events e JOIN supplier l ON l.s_suppkey = e.user_id GROUP BY 1, 2 ORDER BY uniq, lot""")
def feed_diagnosis(spark, d):
    """How many different values a lot's feed has, its range, and its mean ratio; feeds that hardly move come first."""
    e, s = read(spark, d, "events"), read(spark, d, "supplier")
    x = e.join(s, e["user_id"] == s["s_suppkey"])
    g = x.groupBy(F.col("s_suppkey").alias("lot"), F.col("s_name").alias("name")).agg(
        F.count("*").alias("n"), F.countDistinct(F.floor("value")).alias("uniq"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.try_divide(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), F.count("*") * F.max("s_nationkey")), 6).alias("ratio"),
    )
    return g.orderBy("uniq", "lot")


@query("SELECT e.ts, e.event_id, e.user_id AS lot, s.s_name AS name, s.s_nationkey AS nation, e.event_type AS kind, e.value FROM events e JOIN supplier s ON s.s_suppkey = e.user_id")
def csv_export(spark, d):
    """Observations with their lot's columns, written in order of time as CSV, and read back."""
    e, s, path = read(spark, d, "events"), read(spark, d, "supplier"), f"{work_folder(spark)}/export"
    x = e.join(s, e["user_id"] == s["s_suppkey"]).select("ts", "event_id", F.col("user_id").alias("lot"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("event_type").alias("kind"), "value")
    files.write_csv(x.orderBy("ts", "event_id"), path)
    return files.read_csv(spark, path, "ts timestamp_ntz, event_id long, lot long, name string, nation int, kind string, value double")


@query("""WITH s AS (SELECT event_type, count(*) AS n, CAST(floor(avg(value)) AS BIGINT) AS mean FROM events GROUP BY 1)
SELECT 0 AS line, '| kind | n | mean |' AS text UNION ALL SELECT 1, '|---|---:|---:|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY event_type), '| ' || event_type || ' | ' || n || ' | ' || mean || ' |' FROM s""")
def markdown_report(spark, d):
    """A small table as the lines of a Markdown report."""
    from pyspark.sql import Window

    s = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.floor(F.avg("value")).alias("mean"))
    cell = F.concat(F.lit("| "), F.concat_ws(" | ", "event_type", F.col("n").cast("string"), F.col("mean").cast("string")), F.lit(" |"))
    body = s.select((1 + F.row_number().over(Window.orderBy("event_type"))).alias("line"), cell.alias("text"))  # a row a kind
    return spark.createDataFrame([(0, "| kind | n | mean |"), (1, "|---|---:|---:|")], "line int, text string").union(body)


@query("SELECT table_name AS name, column_name AS col FROM information_schema.columns WHERE table_name IN ('events', 'supplier')")
def catalog_columns(spark, d):
    """The columns of registered tables, from the session's catalog."""
    out = []
    for t in ("events", "supplier"):
        read(spark, d, t).createOrReplaceTempView(f"inspected_{t}")
        out += [(t, c.name) for c in spark.catalog.listColumns(f"inspected_{t}")]
        spark.catalog.dropTempView(f"inspected_{t}")
    return spark.createDataFrame(out, "name string, col string")


@query("SELECT table_name AS name, column_name AS found FROM information_schema.columns WHERE (table_name = 'supplier' AND column_name = 's_name') OR (table_name = 'orders' AND column_name LIKE '%date%') OR (table_name = 'orders' AND column_name LIKE '%price%')")
def column_discovery(spark, d):
    """Columns found by a list of candidates, or else by keywords in their names."""
    out = [("supplier", c) for c in files.find_columns(read(spark, d, "supplier").columns, ["lot_name", "S_NAME"], ["name"])]
    out += [("orders", c) for c in files.find_columns(read(spark, d, "orders").columns, ["when"], ["Date", "price"])]
    return spark.createDataFrame(out, "name string, found string")
