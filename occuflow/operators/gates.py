"""Gates: tables that say where a forecast may be shown. A table is absent, invalid, empty or ready, and that decides what is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import day_group, minute_of_day
from .intervals import contains
from .rules import DAY_GROUPS, windows

#: States of a lot's feed on a kind of day.
STATUSES = ("available", "frozen", "evaluation_pending", "anomaly", "dead_feed")


def accuracy_rules(rows: DataFrame) -> DataFrame:
    """One row: the state of an accuracy table (lot, horizon, status, reason) of texts, and its codes of faults.

    ``invalid`` if an id or horizon isn't a whole number or a pair of them repeats, ``empty`` or ``ready``.
    """
    whole = lambda c: F.when(F.regexp_like(F.trim(c), F.lit(r"^[+-]?[0-9]{1,18}\z")), F.trim(c).try_cast("long"))
    x = rows.select(whole("lot").alias("lot"), whole("horizon").alias("horizon"))
    counted = x.groupBy("lot", "horizon").agg(F.count("*").alias("c"))
    bad, again = F.col("lot").isNull() | F.col("horizon").isNull(), F.col("c") > 1
    state = counted.agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad"), F.bool_or(again & ~bad).alias("again"))
    none = F.lit(None).cast("string")
    codes = F.array_compact(F.array(F.when(F.col("bad"), "invalid_id_or_horizon").otherwise(none), F.when(F.col("again"), "duplicate").otherwise(none)))
    return state.select(F.when(F.size(codes) > 0, "invalid").when(F.col("n") == 0, "empty").otherwise("ready").alias("state"), codes.alias("codes"))


def accuracy_check(asked: DataFrame, rows: DataFrame | None) -> DataFrame:
    """(lot, horizon) with ``allowed`` and ``status``: certified pairs are open; others are closed, and all are if the table is invalid.

    An absent or empty table closes nothing, but says ``gate_absent``: a gate that isn't built yet doesn't switch the service off.
    """
    if rows is None:
        return asked.withColumns({"allowed": F.lit(True), "status": F.lit("gate_absent")})
    state = accuracy_rules(rows).select("state")  # one row
    rules = rows.select(F.trim("lot").try_cast("long").alias("lot"), F.trim("horizon").try_cast("long").alias("horizon"), F.col("status").alias("said")).groupBy("lot", "horizon").agg(F.min("said").alias("said"))
    x = asked.join(rules, ["lot", "horizon"], "left").join(F.broadcast(state), F.lit(True))
    status = F.when(F.col("state") == "invalid", "gate_invalid").when(F.col("state") == "empty", "gate_absent").otherwise(F.coalesce("said", F.lit("not_evaluated")))
    return x.withColumn("status", status).withColumn("allowed", F.col("status").isin("certified", "gate_absent")).drop("state", "said")


def prediction_rules(rows: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, issues) of a table of texts (line, lot, day_group, windows, status, reason, evidence, evaluated_at).

    One issue anywhere empties the rules: what was open before closes too.
    """
    number = F.when(F.regexp_like(F.trim("lot"), F.lit(r"^[+-]?[0-9]{1,18}\z")), F.trim("lot").try_cast("long"))
    x = rows.select("line", number.alias("id"), *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("day_group", "windows", "status", "reason", "evidence", "evaluated_at")])
    x = x.join(lots.select(F.col("lot").cast("long").alias("id"), F.lit(True).alias("known")), "id", "left").withColumn("w", windows(F.col("windows"), False))
    dated = F.regexp_like("evaluated_at", F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")) & F.col("evaluated_at").try_cast("date").isNotNull()
    usable = F.coalesce(F.col("known") & dated, F.lit(False))
    some = F.coalesce(F.size("w.xs"), F.lit(0)) > 0
    checks = [
        ("row", "invalid_enum", ~F.col("day_group").isin(*DAY_GROUPS) | ~F.col("status").isin(*STATUSES)), ("row", "missing_evidence", (F.col("reason") == "") | (F.col("evidence") == "")),
        ("windows", "missing_windows", (F.col("status") == "available") & ~some), ("windows", "status_conflict", F.col("status").isin("dead_feed", "evaluation_pending") & some),
    ]
    issue = lambda column, code, when: F.when(when, F.struct(F.lit(column).alias("column"), code.alias("code")))
    further = [issue(column, F.lit(code), usable & when) for column, code, when in checks] + [issue("windows", F.col("w.code"), usable & F.col("w.code").isNotNull())]
    every = F.array(issue("row", F.lit("invalid_id_or_date"), ~usable), *further)
    of_rows = x.select("line", F.explode(F.filter(every, lambda i: i.isNotNull())).alias("i")).select("line", "i.column", "i.code")
    # of equal rules all but the first line are issues
    firsts = x.where(usable).groupBy("id", "day_group").agg(F.min("line").alias("first"), F.count("*").alias("c")).where("c > 1")
    twice = x.where(usable).join(firsts, ["id", "day_group"]).where("line > first").select("line", F.lit("row").alias("column"), F.lit("duplicate_rule").alias("code"))
    issues = of_rows.union(twice)
    valid = issues.agg((F.count("*") == 0).alias("valid"))  # one row
    rules = x.where(usable).select(F.col("id").alias("lot"), "day_group", F.col("w.xs").alias("xs"), "status", "reason")
    return rules.join(F.broadcast(valid), F.lit(True)).where("valid").drop("valid"), issues


def at(asked: DataFrame, rules: DataFrame, time: str, holiday: Column | None, name: str) -> DataFrame:
    """Rows with ``name``, a struct (allowed, status, reason) of the gate at one time; without a rule it is closed as ``evaluation_pending``."""
    mine = rules.select("lot", F.col("day_group").alias("group_"), F.struct("xs", "status", "reason").alias("rule_"))
    x = asked.withColumn("group_", day_group(time, holiday)).join(mine, ["lot", "group_"], "left")
    inside = F.coalesce(contains(F.col("rule_.xs"), minute_of_day(time)), F.lit(False))
    status = F.when(F.col("rule_").isNull(), "evaluation_pending").when(inside, "available").otherwise(F.when(F.col("rule_.status") == "available", "unavailable").otherwise(F.col("rule_.status")))
    reason = F.when(F.col("rule_").isNull(), "no_verified_window").when(inside, "verified_window").otherwise(F.col("rule_.reason"))
    return x.withColumn(name, F.struct(inside.alias("allowed"), status.alias("status"), reason.alias("reason"))).drop("group_", "rule_")


def prediction_check(asked: DataFrame, rules: DataFrame, seen: str, arrival: str, holidays: Column | None = None, arrival_holidays: Column | None = None) -> DataFrame:
    """Rows with allowed, status and reason: the gate must be open at the time of the observation and at that of the arrival; the first that isn't says why."""
    x = at(at(asked, rules, seen, holidays, "a_"), rules, arrival, arrival_holidays, "b_")
    both = F.when(~F.col("a_.allowed"), F.col("a_")).otherwise(F.col("b_"))
    return x.withColumn("g_", both).select(*asked.columns, "g_.*")


def open_state(windows_: Column, overnight: Column, minute: Column) -> Column:
    """Three-valued: whether a lot with known windows can be entered at a minute; null where its schedule isn't known."""
    return F.when(windows_.isNull(), None).when(F.coalesce(overnight, F.lit(False)), True).otherwise(contains(windows_, minute))
