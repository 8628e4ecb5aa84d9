"""Audit findings, comparisons of models on the same rows, inserts by a composite key, features without information, and written reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..operators import evaluation as ev
from ..registry import query
from ..sources.reports import write_report
from ..sources.tables import OBS, observations, read
from ..streaming.windows import work_folder
from .evaluation import CORE, METHODS, PAIRS, pairs, r6


@query(f"""WITH {OBS}, late AS (SELECT * FROM obs WHERE ts >= (SELECT max(ts) FROM obs) - INTERVAL 240 HOURS), t AS (SELECT ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts)) / 60000000.0 AS m FROM (SELECT DISTINCT ts FROM late)),
s AS (SELECT *, park * 1.0 / cells AS share FROM late WHERE cells > 0), d AS (SELECT *, abs(share - lag(share) OVER w) AS change, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60000000.0 AS elapsed FROM s WINDOW w AS (PARTITION BY lot ORDER BY ts, park)),
f AS (SELECT 'polling_gap' AS code, count(*) FILTER (WHERE m > 30) AS n, TRUE AS fails FROM t UNION ALL SELECT 'snapshot_shortfall', CASE WHEN count(*) < 2592 THEN 1 ELSE 0 END, TRUE FROM t UNION ALL SELECT 'over_capacity', count(*), TRUE FROM s WHERE park > cells
UNION ALL SELECT 'step_change', count(*), TRUE FROM d WHERE change > 0.3 AND elapsed <= 120 UNION ALL SELECT 'frozen_count', count(*), FALSE FROM (SELECT lot FROM s GROUP BY lot HAVING max(share) - min(share) < 0.4 AND count(*) >= 3))
SELECT code, n, fails FROM f WHERE n > 0 OR code = 'frozen_count'""")
def audit_findings(spark, d):
    """What an audit of the last ten days finds, by code, and whether it fails."""
    return audit.findings(observations(spark, d), 240, 30, 5, 0.3, 120, 0.4, 3)


@query(f"""WITH {PAIRS}, e AS (SELECT horizon, CAST(target_time AS DATE) AS day, abs(persistence - actual) AS a, abs(lag_24h - actual) AS b, abs(lag_7d - actual) AS c FROM pairs WHERE {CORE} AND lag_7d IS NOT NULL), d AS (SELECT horizon, day, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM e GROUP BY ALL),
s AS (SELECT horizon, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM e GROUP BY 1), x AS (SELECT horizon, count(*) AS days, count(*) FILTER (WHERE b < a) AS better_24h, count(*) FILTER (WHERE c < a) AS better_7d FROM d GROUP BY 1)
SELECT horizon, n, days, round(a, 6) AS persistence, round(b, 6) AS lag_24h, round(c, 6) AS lag_7d, better_24h, better_7d, CASE WHEN a <= b AND a <= c THEN 'persistence' WHEN b <= c THEN 'lag_24h' ELSE 'lag_7d' END AS best FROM s JOIN x USING (horizon)""")
def model_comparison(spark, d):
    """Three forecasts on the rows that all have: mean errors, the days on which each beats persistence, and the best; of equals the first."""
    p = pairs(spark, d).where(ev.complete([*METHODS, "actual"])).select("horizon", F.to_date("target_time").alias("day"), *[ev.errors(m).alias(m) for m in METHODS])
    # sums by day serve both: the days' means and the whole's
    days = p.groupBy("horizon", "day").agg(F.count("*").alias("c"), *[F.sum(m).alias(m) for m in METHODS])
    better = lambda m: F.count_if(F.col(m) / F.col("c") < F.col("persistence") / F.col("c"))
    s = days.groupBy("horizon").agg(F.sum("c").alias("n"), F.count("*").alias("days"), *[(F.sum(m) / F.sum("c")).alias(f"m_{m}") for m in METHODS], better("lag_24h").alias("better_24h"), better("lag_7d").alias("better_7d"))
    best = F.array_min(F.array(*[F.struct(F.col(f"m_{m}").alias("e"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(METHODS)]))["m"]
    return s.select("horizon", "n", "days", *[r6(f"m_{m}").alias(m) for m in METHODS], "better_24h", "better_7d", best.alias("best"))


@query("""WITH b AS (SELECT date_trunc('hour', ts) AS ts, user_id, event_type, event_id, value, 0 AS batch FROM events WHERE event_id % 3 < 2 UNION ALL SELECT date_trunc('hour', ts), user_id, event_type, event_id, value + 1, 1 FROM events)
SELECT ts, user_id, event_type, event_id, value, batch FROM b QUALIFY row_number() OVER (PARTITION BY ts, user_id, event_type ORDER BY batch, event_id) = 1""")
def composite_insert(spark, d):
    """Two batches under a key of hour, lot and kind: what is there already stays, and a batch adds only new keys."""
    e = read(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "event_id", "value")
    return audit.insert_first([e.where("event_id % 3 < 2"), e.withColumn("value", F.col("value") + 1)], ["ts", "user_id", "event_type"], "event_id")


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1, label FROM embeddings")
def informative_features(spark, d):
    """Features without those that are constant or null on the rows of one label."""
    e = read(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(2)], "label", F.lit(7.0).alias("flat"), (F.col("label") * 2).alias("twice"), F.lit(None).cast("double").alias("none"))
    return audit.informative(e, ["x0", "x1", "flat", "twice", "none"], F.col("label") == 3)


STATUS = "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(38, 2)) AS total FROM orders GROUP BY 1"
SEGMENTS = "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"


def _manifest(name: str, columns: list[str]) -> str:
    cells = [f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns]
    csv, md = " || ',' || ".join(cells), "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"
    heads = {"csv": [",".join(columns)], "md": ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{kind}' AS kind, (SELECT count(*) FROM {name}) AS rows, {len(columns)} AS columns, md5(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT {line} AS line FROM {name} UNION ALL {' UNION ALL '.join(f'SELECT {h!r}' for h in heads[kind])})"
        for kind, line in (("csv", csv), ("md", md))
    )


@query(f"WITH status AS ({STATUS}), segments AS ({SEGMENTS}) {_manifest('status', ['status', 'n', 'total'])} UNION ALL {_manifest('segments', ['segment', 'n'])}")
def report_files(spark, d):
    """Two results written as CSV and Markdown with a manifest, which is read again: rows, columns and digests of what the files hold."""
    status = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
    segments = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return write_report(spark, f"{work_folder(spark)}/report", {"status": status, "segments": segments})
