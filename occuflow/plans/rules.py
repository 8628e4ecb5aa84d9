"""Rule files and gates over rows derived from the tables: coded issues row by row, gate states and what they let through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from ..operators import rules as ru
from ..operators.calendar import IN_HOLIDAYS, is_holiday
from ..operators.features import minute_of_day
from ..registry import query
from ..sources.tables import LOTS, lots, read

K = "o_orderkey"
WINDOW_TEXTS = ["09:00-18:00", "", "closed", "00:00-24:00", "09:00-12:00|13:00-18:00", "9:00-18:00", "22:00-06:00", "09:00-09:00", "24:00-24:00", "10:00-12:00|11:00-13:00", "06:00-10:00", "08:00-25:00", "09:00-18:00|"]


def pick(xs: list[str], by: str) -> str:
    return f"CASE ({by}) % {len(xs)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"


#: A rule row made of each order: its texts as SQL that both engines read alike. Most are sound, some are not.
ROW = {
    "line": K, "extra": f"{K} % 97 = 0", "parking_id": f"CASE WHEN {K} % 53 = 0 THEN 'x1' WHEN {K} % 59 = 0 THEN '0' ELSE CAST(2 + 2 * (o_custkey % 60) AS VARCHAR(20)) END",
    "name": f"CASE WHEN {K} % 61 = 0 THEN '' WHEN {K} % 67 = 0 THEN 'other' ELSE concat('Supplier#', lpad(CAST(2 + 2 * (o_custkey % 60) AS VARCHAR(20)), 9, '0')) END",
    "day_group": pick(["weekday", "saturday", "sunday_holiday", "weekday", "saturday", "sunday_holiday", "holiday"], f"{K} * 5 + o_custkey"),
    "entry_windows": pick(WINDOW_TEXTS, f"{K} * 7"), "exit_windows": pick(WINDOW_TEXTS, f"{K} * 3 + 1"), "fee_windows": pick(WINDOW_TEXTS, "o_custkey * 11"), "fee_mode": pick([*ru.FEE_MODES, "monthly"], f"{K} + o_custkey"),
    "overnight_allowed": pick(["true", "false", "yes"], K), "access_status": pick([*ru.STATUSES, "confirmed_open", "open"], f"o_custkey + {K} * 2"), "general_public": pick(["true", "true", "false", ""], f"{K} * 3"),
    "effective_from": pick(["2024-01-01", "2024-03-01", "", "2024-02-30", "2024-01-15", "2024/01/01", "2024-06-01"], f"{K} * 2 + o_custkey"), "effective_to": pick(["", "2024-02-29", "2023-12-31", "", "soon"], f"o_custkey + {K}"),
    "checked_at": pick(["2024-01-10", "", "2024-13-01", "2024-01-11"], f"{K} + 2"), "evidence_method": pick(["phone", "field", "", "hearsay", "official_web"], f"o_custkey * 3 + {K}"), "evidence_ref": pick(["call", "", "page"], f"o_custkey + {K} * 2"), "note": "''",
}


#: The rules of each odd lot, one for each day group; of one lot in eleven they lack evidence.
SOUND = {
    "line": "100000000 + s_suppkey * 3 + g", "extra": "FALSE", "parking_id": "CAST(s_suppkey AS VARCHAR(20))", "name": "s_name", "day_group": "CASE g WHEN 0 THEN 'weekday' WHEN 1 THEN 'saturday' ELSE 'sunday_holiday' END",
    "entry_windows": pick(["00:00-24:00", "07:00-22:00", "13:00-20:00|09:00-12:00", "06:00-10:00", "closed"], "s_suppkey + g"), "exit_windows": pick(["00:00-24:00", "06:00-23:00", "08:00-20:00"], "s_suppkey"), "fee_windows": "CASE g WHEN 0 THEN '09:00-18:00' WHEN 1 THEN '00:00-24:00' ELSE '' END",
    "fee_mode": "CASE g WHEN 0 THEN 'paid_window_free_outside' WHEN 1 THEN 'paid_24h' ELSE 'free' END", "overnight_allowed": "CASE WHEN s_suppkey % 9 = 0 THEN 'true' ELSE 'false' END", "access_status": "'confirmed_restricted'", "general_public": "'true'",
    "effective_from": "'2024-01-01'", "effective_to": "''", "checked_at": "'2024-01-02'", "evidence_method": "'phone'", "evidence_ref": "CASE WHEN s_suppkey % 11 = 3 THEN '' ELSE 'call' END", "note": "''",
}


def rule_rows(spark, d):
    made = lambda df, row: df.select(*[F.expr(v.replace("VARCHAR(20)", "STRING")).alias(c) for c, v in row.items()])
    odd = read(spark, d, "supplier").where("s_suppkey % 2 = 1").crossJoin(spark.range(3).withColumnRenamed("id", "g"))  # three day groups
    return made(read(spark, d, "orders"), ROW).unionByName(made(odd, SOUND))


def window_sql(c: str, closed: bool) -> str:
    """Columns {c}_code and {c}_xs of a text of windows, in SQL."""
    minute = lambda at, end: f"CASE WHEN TRY_CAST(substr(t, {at}, 2) AS INT) < 24 AND TRY_CAST(substr(t, {at + 3}, 2) AS INT) < 60 {'OR substr(t, %d, 5) = %s' % (at, chr(39) + '24:00' + chr(39)) if end else ''} THEN TRY_CAST(substr(t, {at}, 2) AS INT) * 60 + TRY_CAST(substr(t, {at + 3}, 2) AS INT) END"
    s, e = minute(1, False), minute(7, True)
    tokens = f"list_transform(string_split({c}_windows, '|'), lambda t: CASE WHEN NOT regexp_full_match(t, '[0-9]{{2}}:[0-9]{{2}}-[0-9]{{2}}:[0-9]{{2}}') THEN 'invalid_window' WHEN ({s}) IS NULL OR ({e}) IS NULL THEN 'invalid_time' WHEN ({s}) = ({e}) THEN 'ambiguous_zero_window' WHEN ({s}) > ({e}) THEN 'cross_midnight_window' END)"
    fault = f"list_filter({tokens}, lambda k: k IS NOT NULL)[1]"
    xs = f"list_sort(list_transform(string_split({c}_windows, '|'), lambda t: [({s}), ({e})]))"
    meets = f"len(list_filter(range(1, len({xs})), lambda i: {xs}[i + 1][1] < {xs}[i][2])) > 0"
    code = f"CASE WHEN {c}_windows = '' THEN NULL WHEN {c}_windows = 'closed' THEN {'NULL' if closed else repr('closed_not_allowed')} WHEN {fault} IS NOT NULL THEN {fault} WHEN {meets} THEN 'overlapping_windows' END"
    return f"{code} AS {c}_code, CASE WHEN {c}_windows = '' OR ({code}) IS NOT NULL THEN NULL WHEN {c}_windows = 'closed' THEN [] ELSE {xs} END AS {c}_xs"


DATE = "CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({c} AS DATE) END"
RULES_SQL = f"""{LOTS}, r AS (SELECT {', '.join(f'{v} AS {c}' for c, v in ROW.items())} FROM orders UNION ALL SELECT {', '.join(SOUND.values())} FROM supplier, range(3) t(g) WHERE s_suppkey % 2 = 1),
p AS (SELECT r.*, CASE WHEN regexp_full_match(parking_id, '[+]?[0-9]+') AND TRY_CAST(parking_id AS BIGINT) > 0 THEN TRY_CAST(parking_id AS BIGINT) END AS pid, {', '.join(window_sql(c, c != 'fee') for c in ('entry', 'exit', 'fee'))}, {', '.join(DATE.format(c=c) + ' AS ' + n for c, n in (('effective_from', 'starts'), ('effective_to', 'ends'), ('checked_at', 'checked')))} FROM r),
x AS (SELECT p.*, lots.name AS lot_name, len(entry_xs) AS entry_n, len(exit_xs) AS exit_n, len(fee_xs) AS fee_n, coalesce(fee_xs = [[0, 1440]], FALSE) AS fee_whole FROM p LEFT JOIN lots ON lots.lot = p.pid),
known AS (SELECT line, pid, day_group, starts, ends FROM x WHERE pid IS NOT NULL AND starts IS NOT NULL AND day_group IN {ru.words(ru.DAY_GROUPS)}),
i AS ({' UNION ALL '.join(f"SELECT line, '{column}' AS col, '{code}' AS code FROM x WHERE {when}" for column, code, when in ru.CHECKS)}
{' '.join(f"UNION ALL SELECT line, '{c}_windows', {c}_code FROM x WHERE {c}_code IS NOT NULL" for c in ('entry', 'exit', 'fee'))}
UNION ALL SELECT line, 'day_group', 'duplicate_day_group' FROM known QUALIFY row_number() OVER (PARTITION BY pid, starts, ends, day_group ORDER BY line) > 1
UNION ALL SELECT min(line), 'day_group', 'missing_day_groups' FROM known GROUP BY pid, starts, ends HAVING count(DISTINCT day_group) < 3
UNION ALL SELECT line, 'effective_from', 'overlapping_effective_periods' FROM (SELECT *, lag(coalesce(ends, DATE '9999-12-31')) OVER (PARTITION BY pid, day_group ORDER BY starts, line) AS before FROM known) WHERE starts <= before)"""


@query(f'WITH {RULES_SQL} SELECT line, col AS "column", code FROM i')
def rule_issues(spark, d):
    """Every issue of every rule row, with its line, column and code: values, references, and sets of rows by lot, period and day group."""
    return ru.validate(rule_rows(spark, d), lots(spark, d))


@query(f"WITH {RULES_SQL} SELECT line, pid AS lot, day_group, starts, ends, to_json(entry_xs)::VARCHAR AS entry, to_json(exit_xs)::VARCHAR AS leave, to_json(fee_xs)::VARCHAR AS fee FROM x WHERE line NOT IN (SELECT line FROM i)")
def sound_rules(spark, d):
    """The typed values of the rule rows without an issue."""
    x = ru.sound(rule_rows(spark, d), lots(spark, d))
    shown = lambda c: F.to_json(F.transform(f"{c}.xs", lambda w: F.array(w["s"], w["e"])))
    return x.select("line", F.col("pid").alias("lot"), "day_group", "starts", "ends", shown("entry").alias("entry"), shown("exit").alias("leave"), shown("fee").alias("fee"))


#: Accuracy tables made of the parts: one is sound, one has a pair twice, one an id that is no number, one is empty, one isn't there.
TABLES = {"ready": "p_partkey BETWEEN 1 AND 60", "twice": "p_partkey BETWEEN 1 AND 60 OR p_partkey = 120", "wrong": "p_partkey BETWEEN 2 AND 61", "empty": "FALSE"}
ACCURACY = {"lot": "CASE WHEN p_partkey = 61 THEN 'x' ELSE CAST(1 + p_partkey % 20 AS VARCHAR(20)) END", "horizon": "CASE WHEN p_partkey % 3 = 0 THEN '60' WHEN p_partkey % 3 = 1 THEN '120' ELSE '240' END", "status": "CASE WHEN p_partkey % 4 < 2 THEN 'certified' WHEN p_partkey % 4 = 2 THEN 'mae_too_large' ELSE 'few_rows' END"}


@query(f"""WITH a AS (SELECT p_partkey, {', '.join(f'{v} AS {c}' for c, v in ACCURACY.items())} FROM part), tables AS ({' UNION ALL '.join(f"SELECT '{n}' AS gate, a.* FROM a WHERE {w}" for n, w in TABLES.items())}),
states AS (SELECT g.gate, CASE WHEN g.gate = 'absent' THEN 'absent' WHEN bool_or(t.gate IS NOT NULL AND (c > 1 OR TRY_CAST(lot AS BIGINT) IS NULL)) THEN 'invalid' WHEN count(lot) = 0 THEN 'empty' ELSE 'ready' END AS state FROM (VALUES ('ready'), ('twice'), ('wrong'), ('empty'), ('absent')) g(gate) LEFT JOIN (SELECT gate, lot, horizon, count(*) AS c FROM tables GROUP BY ALL) t ON t.gate = g.gate GROUP BY g.gate),
asked AS (SELECT CAST(s_suppkey AS BIGINT) AS lot, CAST(h AS BIGINT) AS horizon FROM supplier, (VALUES (60), (120), (240)) t(h)),
s AS (SELECT states.gate, state, asked.lot, asked.horizon, CASE WHEN state = 'invalid' THEN 'gate_invalid' WHEN state IN ('absent', 'empty') THEN 'gate_absent' ELSE coalesce(t.status, 'not_evaluated') END AS status FROM asked CROSS JOIN states LEFT JOIN tables t ON t.gate = states.gate AND t.lot = CAST(asked.lot AS VARCHAR) AND t.horizon = CAST(asked.horizon AS VARCHAR) AND state = 'ready')
SELECT gate, lot, horizon, status IN ('certified', 'gate_absent') AS allowed, status FROM s""")
def accuracy_gate_states(spark, d):
    """Whether each lot and horizon is open under five accuracy tables: sound, with a pair twice, with a wrong id, empty and absent."""
    a = read(spark, d, "part").select("p_partkey", *[F.expr(v.replace("VARCHAR(20)", "STRING")).alias(c) for c, v in ACCURACY.items()])
    asked = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("lot"), F.explode(F.array(*[F.lit(h).cast("long") for h in (60, 120, 240)])).alias("horizon"))
    out = None
    for name in (*TABLES, "absent"):
        one = gates.accuracy_check(asked, a.where(TABLES[name]) if name in TABLES else None).select(F.lit(name).alias("gate"), "lot", "horizon", "allowed", "status")
        out = one if out is None else out.unionByName(one)
    return out


#: A prediction table made of the suppliers: a row for each of three day groups, with one status in five not open.
GATE = {
    "line": "s_suppkey * 3 + g", "lot": "CAST(s_suppkey AS VARCHAR(20))", "day_group": "CASE g WHEN 0 THEN 'weekday' WHEN 1 THEN 'saturday' ELSE 'sunday_holiday' END", "status": pick(["available", "available", "available", "frozen", "dead_feed", "anomaly", "evaluation_pending"], "s_suppkey + g"),
    "windows": "CASE WHEN (s_suppkey + g) % 7 IN (4, 6) THEN '' WHEN s_suppkey % 3 = 0 THEN '00:00-24:00' WHEN s_suppkey % 3 = 1 THEN '07:00-12:00|13:00-22:00' ELSE '18:00-24:00' END", "reason": "'measured'", "evidence": "'report'", "evaluated_at": "'2024-01-05'",
}
GROUP = f"CASE WHEN CAST({{t}} AS DATE) {IN_HOLIDAYS} OR isodow({{t}}) = 7 THEN 'sunday_holiday' WHEN isodow({{t}}) = 6 THEN 'saturday' ELSE 'weekday' END"


def gate_sql(t: str, n: str) -> str:
    inside = f"({n}.lot IS NOT NULL AND (CASE WHEN {n}.status IN ('dead_feed', 'evaluation_pending') THEN FALSE WHEN {n}.lot % 3 = 0 THEN TRUE WHEN {n}.lot % 3 = 1 THEN m_{n} >= 420 AND m_{n} < 720 OR m_{n} >= 780 AND m_{n} < 1320 ELSE m_{n} >= 1080 END))"
    return f"{inside} AS in_{n}, CASE WHEN {n}.lot IS NULL THEN 'evaluation_pending' WHEN {inside} THEN 'available' WHEN {n}.status = 'available' THEN 'unavailable' ELSE {n}.status END AS st_{n}"


@query(f"""WITH g AS (SELECT {', '.join(f'{v} AS {c}' for c, v in GATE.items() if c not in ('lot', 'windows'))}, CAST(s_suppkey AS BIGINT) AS lot FROM supplier, range(3) t(g)),
e AS (SELECT event_id, user_id AS l, ts, ts + (event_id % 300) * INTERVAL 1 MINUTE AS arrival FROM events), m AS (SELECT *, hour(ts) * 60 + minute(ts) AS m_a, hour(arrival) * 60 + minute(arrival) AS m_b, {GROUP.format(t='ts')} AS g_a, {GROUP.format(t='arrival')} AS g_b FROM e),
x AS (SELECT event_id, {gate_sql('ts', 'a')}, {gate_sql('arrival', 'b')} FROM m LEFT JOIN g a ON a.lot = m.l AND a.day_group = g_a LEFT JOIN g b ON b.lot = m.l AND b.day_group = g_b)
SELECT event_id, in_a AND in_b AS allowed, CASE WHEN NOT in_a THEN st_a ELSE st_b END AS status FROM x""")
def prediction_gate(spark, d):
    """Whether a forecast may be shown: the gate must be open when the lot was seen and when the car arrives; else the first closed one says why."""
    rows = read(spark, d, "supplier").crossJoin(spark.range(3).withColumnRenamed("id", "g")).select(*[F.expr(v.replace("VARCHAR(20)", "STRING")).alias(c) for c, v in GATE.items()])  # three day groups
    rules, _ = gates.prediction_rules(rows, lots(spark, d))
    e = read(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("lot"), "ts", F.timestamp_add("MINUTE", F.pmod("event_id", F.lit(300)).cast("int"), F.col("ts")).alias("arrival"))
    out = gates.prediction_check(e, rules, "ts", "arrival", is_holiday(F.to_date("ts")), is_holiday(F.to_date("arrival")))
    return out.select("event_id", "allowed", "status")


@query(f"""WITH {RULES_SQL}, ok AS (SELECT pid, day_group, min(entry_xs) AS xs, bool_or(overnight_allowed = 'true') AS night FROM x WHERE line NOT IN (SELECT line FROM i) GROUP BY ALL),
e AS (SELECT event_id, user_id AS l, ts, ts + INTERVAL 6 HOURS AS later FROM events), m AS (SELECT *, hour(ts) * 60 + minute(ts) AS ma, hour(later) * 60 + minute(later) AS mb FROM e),
o AS (SELECT event_id, CASE WHEN a.pid IS NULL THEN NULL WHEN a.night THEN TRUE ELSE len(list_filter(a.xs, lambda w: ma >= w[1] AND ma < w[2])) > 0 END AS now, CASE WHEN b.pid IS NULL THEN NULL WHEN b.night THEN TRUE ELSE len(list_filter(b.xs, lambda w: mb >= w[1] AND mb < w[2])) > 0 END AS then_
FROM m LEFT JOIN ok a ON a.pid = m.l AND a.day_group = {GROUP.format(t='ts')} LEFT JOIN ok b ON b.pid = m.l AND b.day_group = {GROUP.format(t='later')})
SELECT coalesce(CAST(now AS VARCHAR), 'unknown') AS now, coalesce(CAST(then_ AS VARCHAR), 'unknown') AS later, coalesce(CAST(now AND then_ AS VARCHAR), 'unknown') AS both, count(*) AS n FROM o GROUP BY ALL""")
def accessibility_states(spark, d):
    """Three-valued accessibility of a lot now, six hours later and at both times: unknown isn't closed, and one closed time closes both."""
    x = ru.sound(rule_rows(spark, d), lots(spark, d))
    ok = x.groupBy("pid", "day_group").agg(F.min("entry.xs").alias("xs"), F.bool_or(F.col("overnight_allowed") == "true").alias("night"))

    def state(df, time: str, name: str):
        group = gates.day_group(time, is_holiday(F.to_date(time)))
        one = df.withColumn("group_", group).join(ok.select(F.col("pid").alias("lot"), F.col("day_group").alias("group_"), "xs", "night"), ["lot", "group_"], "left")
        return one.withColumn(name, gates.open_state(F.col("xs"), F.col("night"), minute_of_day(time))).drop("group_", "xs", "night")

    e = read(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("lot"), "ts", F.timestamp_add("HOUR", F.lit(6), F.col("ts")).alias("after"))
    o = state(state(e, "ts", "a"), "after", "b")
    word = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return o.groupBy(word(F.col("a")).alias("now"), word(F.col("b")).alias("later"), word(F.col("a") & F.col("b")).alias("both")).agg(F.count("*").alias("n"))
