"""Set operations, top-k, flattening, text cleaning and sources on the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested, text
from ..registry import query
from ..sources.tables import read
from .evaluation import r6


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.absent') AS VARCHAR), 'none') AS absent FROM events")
def json_flatten(spark, d):
    p = F.from_json("props", "k long, absent string")
    return read(spark, d, "events").select("event_id", "user_id", p["k"].alias("k"), F.coalesce(p["absent"], F.lit("none")).alias("absent"))


@query("SELECT event_id, round(abs(value - 100), 6) AS away FROM events ORDER BY abs(value - 100) DESC, event_id LIMIT 25")
def topk_abs(spark, d):
    away = F.abs(F.col("value") - 100)
    return read(spark, d, "events").orderBy(away.desc(), "event_id").limit(25).select("event_id", F.round(away, 6).alias("away"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def topk_per_lot(spark, d):
    """The three largest values of each lot, by a bounded aggregate before the last choice."""
    e = read(spark, d, "events").withColumn("salt", F.pmod("event_id", F.lit(16)))
    top = lambda: F.slice(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id", "value"))), 1, 3)
    # rank within salted parts first, so that a hot lot isn't one task's
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "salt").orderBy(F.desc("value"), "event_id")
    few = e.withColumn("i", F.row_number().over(w)).where("i <= 3")
    return few.groupBy("user_id").agg(top().alias("t")).select("user_id", F.explode("t").alias("x")).select("user_id", "x.event_id", "x.value")


@query("""SELECT 'both' AS side, k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 150000) UNION ALL
SELECT 'customer_only', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000)""")
def setops_ids(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = read(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("k"))
    side = lambda df, n: df.select(F.lit(n).alias("side"), "k")
    return side(c.intersect(o), "both").unionByName(side(c.subtract(o), "customer_only"))


@query("""WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, 0 AS src FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, CAST(ts AS DATE), event_id, 1 FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, CAST(day AS VARCHAR) AS day, event_id, src FROM u QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY src, event_id) = 1""")
def union_dedup(spark, d):
    """Two sources by key, the first one wins: an aggregate with map-side combine, not a window."""
    e = read(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    one = lambda kinds, src: e.where(F.col("event_type").isin(*kinds)).select("user_id", "day", "event_id", F.lit(src).alias("src"))
    first = one(["click"], 0).unionByName(one(["view", "click"], 1)).groupBy("user_id", "day").agg(F.min(F.struct("src", "event_id")).alias("x"))
    return first.select("user_id", "day", "x.event_id", "x.src")


@query("SELECT l_returnflag, l_linestatus, coalesce(l_returnflag, 'all') || '/' || coalesce(l_linestatus, 'all') AS cell, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, round(CAST(sum(CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE) / count(l_discount), 6) AS discount FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def margin_cube(spark, d):
    # rows are summed by the finest cells once, and the cube is over those few
    fine = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.sum(F.col("l_discount").cast("decimal(18,2)")).alias("s"), F.count("l_discount").alias("k"))
    c = fine.cube("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"), F.sum("q").cast("double").alias("quantity"), r6(F.sum("s").cast("double") / F.sum("k")).alias("discount"))
    name = lambda x: F.coalesce(F.col(x), F.lit("all"))
    return c.select("l_returnflag", "l_linestatus", F.concat(name("l_returnflag"), F.lit("/"), name("l_linestatus")).alias("cell"), "n", "quantity", "discount")


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '\([^)]*\)', '', 'g'), '[^a-z0-9]+', '', 'g') AS name, split_part(p_brand, '#', 2) AS brand, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS number,
CASE WHEN p_type ILIKE '%brass%' THEN 'brass' WHEN regexp_matches(p_type, '(STEEL|TIN)') THEN 'plain' ELSE 'other' END AS kind FROM part""")
def name_normalise(spark, d):
    number = F.element_at(F.split("p_brand", "#"), 2)
    kind = F.when(F.lower("p_type").contains("brass"), "brass").when(F.col("p_type").rlike("STEEL|TIN"), "plain").otherwise("other")
    return read(spark, d, "part").select("p_partkey", text.normalised("p_name").alias("name"), number.alias("brand"), number.try_cast("int").alias("number"), kind.alias("kind"))


@query("""WITH x AS (SELECT user_id, sum(value) AS v, count(*) AS n FROM events GROUP BY 1) SELECT user_id, round(ln(1 + n), 6) AS log_n, round(ln(p / (1 - p)), 6) AS log_odds, CAST(round_even(v, 0) AS BIGINT) AS half_even, CAST(ceil(n / 10.0) AS BIGINT) AS tens, CAST(floor(v / 100) * 100 AS BIGINT) AS hundreds
FROM (SELECT *, least(greatest(n / 100.0, 1e-6), 1 - 1e-6) AS p FROM x)""")
def scalar_functions(spark, d):
    """Sums are rounded, so their last bits count: each is added up in the order of the table's rows, as SQL on one thread does, whatever the partitions are. Their sort spills."""
    from pyspark.sql import Window

    e = read(spark, d, "events").select("user_id", "value", F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
    added = e.withColumn("v", F.sum("value").over(Window.partitionBy("user_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = added.groupBy("user_id").agg(F.max_by("v", "at").alias("v"), F.count("*").alias("n"))
    p = F.least(F.greatest(F.col("n") / 100, F.lit(1e-6)), F.lit(1 - 1e-6))
    return x.select("user_id", r6(F.log1p("n")).alias("log_n"), r6(F.log(p / (1 - p))).alias("log_odds"), F.bround("v").cast("long").alias("half_even"), F.ceil(F.col("n") / 10).alias("tens"), (F.floor(F.col("v") / 100) * 100).cast("long").alias("hundreds"))


@query("SELECT l_shipmonth AS month, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01') GROUP BY 1")
def monthly_revenue(spark, d):
    """A range filter that reaches the scan, and two columns of it."""
    x = read(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ'1995-01-01' AND l_shipdate < TIMESTAMP_NTZ'1997-01-01'")
    return x.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


#: Documents as an address service answers them: the items of an order are a list, one object, or missing; numbers come as texts, some of them empty.
ITEM = "named_struct('no', l_linenumber, 'name', l_returnflag, 'homes', if(l_linenumber % 2 = 0, '0', cast(cast(l_quantity AS int) AS string)), 'flats', cast(l_partkey AS string), 'ground', if(l_partkey % 3 = 0, '', cast(l_partkey % 50 AS string)), 'below', if(l_partkey % 5 = 0, NULL, l_partkey % 70))"


def answers(spark, d):
    """(l_orderkey, doc): nested JSON texts, made of the order lines."""
    x = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.expr(ITEM))).alias("items"))
    body = lambda item: F.to_json(F.struct(F.struct(F.struct(item.alias("item")).alias("body")).alias("response")))
    doc = F.when(F.col("l_orderkey") % 4 == 0, body(F.col("items"))).when(F.col("l_orderkey") % 4 == 1, body(F.col("items")[0])).when(F.col("l_orderkey") % 4 == 2, F.lit('{"response": {"body": "none"}}')).otherwise("not json {")
    return x.select("l_orderkey", doc.alias("doc"))


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) END, CAST(l_partkey AS VARCHAR)) = 1 AS first FROM lineitem), k AS (SELECT *, CAST(CAST(trunc(l_quantity) AS INTEGER) AS DOUBLE) AS homes FROM i WHERE l_orderkey % 4 = 0 OR l_orderkey % 4 = 1 AND first)
SELECT l_orderkey, l_linenumber AS no, l_returnflag AS name, CASE WHEN l_linenumber % 2 = 0 OR homes = 0 THEN CAST(l_partkey AS DOUBLE) ELSE homes END AS households, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 50 AS DOUBLE) END AS ground,
coalesce(CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 50 END, 0.0) + coalesce(CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 70 END, 0.0) AS parking, l_orderkey % 4 = 0 AS listed FROM k
UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL, NULL, NULL, 0.0, FALSE FROM lineitem WHERE l_orderkey % 4 >= 2""")
def variant_flatten(spark, d):
    """Nested JSON with a list, an object or nothing at a path, flattened to a row an item; what isn't JSON or lacks the path gives one row of nulls."""
    return nested.flattened(answers(spark, d), "doc", "$.response.body.item").select(
        "l_orderkey", nested.field("no", "int").alias("no"), nested.field("name", "string").alias("name"), nested.first_positive("homes", "flats").alias("households"), nested.number("ground").alias("ground"),
        (F.coalesce(nested.number("ground"), F.lit(0.0)) + F.coalesce(nested.number("below"), F.lit(0.0))).alias("parking"), "listed",
    )
