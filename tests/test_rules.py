from datetime import datetime

import pytest
from pyspark.sql import functions as F

from occuflow.operators import gates
from occuflow.operators import rules as ru
from occuflow.sources.rules import read_rules

LOTS = [(39, "north lot"), (40, "south lot")]


def sound(**changes):
    """The three day groups of a lot without a fault; changes apply to the first."""
    base = {
        "parking_id": "39", "name": "north lot", "entry_windows": "00:00-24:00", "exit_windows": "00:00-24:00", "fee_windows": "", "fee_mode": "free", "overnight_allowed": "true", "access_status": "confirmed_open",
        "general_public": "true", "effective_from": "2026-09-15", "effective_to": "", "checked_at": "2026-09-15", "evidence_method": "phone", "evidence_ref": "a call", "note": None,
    }
    rows = [{**base, "day_group": g} for g in ru.DAY_GROUPS]
    rows[0] |= {"fee_windows": "09:00-17:00", "fee_mode": "paid_window_free_outside"} | changes
    return rows


def lots(spark):
    return spark.createDataFrame(LOTS, "lot long, name string")


def table(spark, rows):
    kinds = "line long, extra boolean, " + ", ".join(f"{f} string" for f in ru.FIELDS)
    return spark.createDataFrame([(i, r.get("extra"), *(r.get(f) for f in ru.FIELDS)) for i, r in enumerate(rows, 2)], kinds)


def issues(spark, rows):
    return sorted((r["line"], r["column"], r["code"]) for r in ru.validate(table(spark, rows), lots(spark)).collect())


CASES = [
    ({}, set()), ({"extra": True}, {("row", "extra_values")}), ({"parking_id": "x"}, {("parking_id", "invalid_parking_id")}), ({"parking_id": "-3"}, {("parking_id", "invalid_parking_id")}), ({"parking_id": "+39"}, set()),
    ({"parking_id": "999"}, {("parking_id", "unknown_parking_id")}), ({"name": "other"}, {("name", "parking_name_mismatch")}), ({"name": " "}, {("name", "required")}), ({"day_group": "holiday"}, {("day_group", "invalid_enum")}),
    ({"access_status": "open"}, {("access_status", "invalid_enum")}), ({"fee_mode": "monthly", "fee_windows": ""}, {("fee_mode", "invalid_enum")}), ({"overnight_allowed": "yes", "general_public": ""}, {("overnight_allowed", "invalid_boolean"), ("general_public", "invalid_boolean")}),
    ({"entry_windows": "9:00-18:00"}, {("entry_windows", "invalid_window"), ("access_status", "confirmed_without_access_hours")}), ({"entry_windows": "09:00-12:00|"}, {("entry_windows", "invalid_window"), ("access_status", "confirmed_without_access_hours")}),
    ({"exit_windows": "24:00-24:00"}, {("exit_windows", "invalid_time"), ("access_status", "confirmed_without_access_hours")}), ({"exit_windows": "08:00-24:01"}, {("exit_windows", "invalid_time"), ("access_status", "confirmed_without_access_hours")}),
    ({"entry_windows": "00:00-00:00"}, {("entry_windows", "ambiguous_zero_window"), ("access_status", "confirmed_without_access_hours")}), ({"entry_windows": "22:00-06:00"}, {("entry_windows", "cross_midnight_window"), ("access_status", "confirmed_without_access_hours")}),
    ({"exit_windows": "09:00-12:00|11:00-14:00"}, {("exit_windows", "overlapping_windows"), ("access_status", "confirmed_without_access_hours")}), ({"exit_windows": "12:00-14:00|09:00-12:00"}, set()), ({"entry_windows": "closed"}, {("access_status", "open_but_closed")}),
    ({"entry_windows": "closed", "access_status": "confirmed_restricted"}, set()), ({"fee_windows": "closed"}, {("fee_windows", "closed_not_allowed"), ("fee_windows", "fee_mode_conflict")}), ({"fee_mode": "free"}, {("fee_windows", "fee_mode_conflict")}),
    ({"fee_mode": "paid_24h"}, {("fee_windows", "fee_mode_conflict")}), ({"fee_mode": "paid_24h", "fee_windows": "00:00-24:00"}, set()), ({"fee_windows": ""}, {("fee_windows", "fee_mode_conflict")}),
    ({"access_status": "unknown", "evidence_method": "", "evidence_ref": ""}, {("access_status", "unknown_with_access_hours")}), ({"access_status": "unknown", "entry_windows": "", "exit_windows": "", "checked_at": "", "evidence_method": "", "evidence_ref": ""}, set()),
    ({"checked_at": ""}, {("checked_at", "required")}), ({"checked_at": "2026-13-01"}, {("checked_at", "invalid_date")}), ({"effective_to": "soon"}, {("effective_to", "invalid_date")}), ({"evidence_method": "hearsay"}, {("evidence_method", "invalid_enum")}),
    ({"evidence_method": "", "evidence_ref": ""}, {("evidence_method", "required"), ("evidence_ref", "required")}),
]


def test_each_fault_of_a_row_has_its_code(spark):
    """All cases at once, each as a lot's first row; sets of rows are judged apart below."""
    rows, want = [], {}
    for i, (changes, codes) in enumerate(CASES):
        rows.append((i, sound(**changes)[0]))
        want[i] = codes
    kinds = "line long, extra boolean, " + ", ".join(f"{f} string" for f in ru.FIELDS)
    df = spark.createDataFrame([(i, r.get("extra"), *(r.get(f) for f in ru.FIELDS)) for i, r in rows], kinds)
    got = {i: set() for i in want}
    for r in ru.row_issues(ru.typed(df, lots(spark))).collect():
        got[r["line"]].add((r["column"], r["code"]))
    assert got == want


def test_sets_of_rows(spark):
    assert issues(spark, sound()) == []
    assert issues(spark, sound()[:2]) == [(2, "day_group", "missing_day_groups")]
    twice = [*sound(), sound()[1]]
    assert issues(spark, twice) == [(5, "day_group", "duplicate_day_group"), (5, "effective_from", "overlapping_effective_periods")]
    later = [r | {"effective_from": "2026-12-01"} for r in sound()]
    assert issues(spark, sound() + later) == [(i, "effective_from", "overlapping_effective_periods") for i in (5, 6, 7)]
    assert issues(spark, [r | {"effective_to": "2026-11-30"} for r in sound()] + later) == []
    assert issues(spark, sound(effective_from="")) == [(2, "effective_from", "required"), (3, "day_group", "missing_day_groups")]
    assert issues(spark, sound(effective_from="2026-09-16", effective_to="2026-09-15"))[0] == (2, "day_group", "missing_day_groups")
    assert issues(spark, [{}, {f: "  " for f in ru.FIELDS}]) == []


def test_typed_values(spark):
    r = ru.typed(table(spark, sound(entry_windows="13:00-15:00|08:30-12:00", exit_windows="closed")), lots(spark)).where("line = 2").first()
    assert [tuple(w) for w in r["entry"]["xs"]] == [(510, 720), (780, 900)] and r["exit"]["xs"] == [] and [tuple(w) for w in r["fee"]["xs"]] == [(540, 1020)] and str(r["starts"]) == "2026-09-15"


def test_rule_files(spark, tmp_path):
    def read(text, name="rules.csv"):
        (tmp_path / name).write_text(text, encoding="utf-8")
        rows, faults = read_rules(spark, str(tmp_path / name), ru.FIELDS)
        return rows, [tuple(r) for r in faults.collect()]

    rows, faults = read_rules(spark, str(tmp_path / "none.csv"), ru.FIELDS)
    assert [tuple(r) for r in faults.collect()] == [(0, "file", "file_not_found")] and rows.count() == 0
    head, lines = ",".join(ru.FIELDS), [",".join(r.get(f) or "" for f in ru.FIELDS) for r in sound()]
    rows, faults = read("﻿" + "\n".join([head, lines[0] + ",more", "", *lines[1:]]) + "\n")
    got = sorted((r["line"], r["column"], r["code"]) for r in ru.validate(rows, lots(spark)).collect())
    assert faults == [] and got == [(2, "row", "extra_values")] and sorted(r["line"] for r in rows.collect()) == [2, 4, 5]
    assert read(head + "\n")[0].count() == 0 and read(head + "\n")[1] == []
    for wrong in (head.replace("parking_id,name", "name,parking_id"), head + ",more", head.rsplit(",", 1)[0]):
        assert read(wrong + "\n" + lines[0])[1] == [(1, "header", "invalid_header")]
    quoted = lines[0].replace("a call", '"a, ""long"" call"')
    assert read(head + "\n" + quoted)[0].first()["evidence_ref"] == 'a, "long" call'


def accuracy(spark, rows):
    asked = spark.createDataFrame([(1, 60), (1, 120), (2, 60)], "lot long, horizon long")
    df = None if rows is None else spark.createDataFrame(rows, "lot string, horizon string, status string")
    return {(r["lot"], r["horizon"]): (r["allowed"], r["status"]) for r in gates.accuracy_check(asked, df).collect()}


def test_states_of_the_accuracy_gate(spark):
    good = [("1", "60", "certified"), ("1", "120", "mae_too_large")]
    assert accuracy(spark, good) == {(1, 60): (True, "certified"), (1, 120): (False, "mae_too_large"), (2, 60): (False, "not_evaluated")}
    for gone in (None, []):
        assert set(accuracy(spark, gone).values()) == {(True, "gate_absent")}
    for bad in ([*good, ("1", "60", "certified")], [*good, ("x", "60", "certified")], [*good, ("3", None, "certified")], [*good, ("1.5", "60", "certified")]):
        assert set(accuracy(spark, bad).values()) == {(False, "gate_invalid")}


GATE = "line long, lot string, day_group string, windows string, status string, reason string, evidence string, evaluated_at string"
ROW = (2, "39", "weekday", "09:00-17:00", "frozen", "frozen_outside", "report", "2026-09-16")


def prediction(spark, rows):
    rules, faults = gates.prediction_rules(spark.createDataFrame(rows, GATE), lots(spark))
    inside, outside = datetime(2026, 9, 16, 16), datetime(2026, 9, 16, 17)
    asked = spark.createDataFrame([(0, 39, inside, inside), (1, 39, inside, outside), (2, 39, outside, inside), (3, 40, inside, inside)], "i int, lot long, a timestamp_ntz, b timestamp_ntz")
    out = gates.prediction_check(asked, rules, "a", "b").orderBy("i").collect()
    return [(r["allowed"], r["status"], r["reason"]) for r in out], sorted((r["line"], r["code"]) for r in faults.collect())


def test_the_prediction_gate_checks_both_times_and_closes_on_any_fault(spark):
    pending = (False, "evaluation_pending", "no_verified_window")
    assert prediction(spark, []) == ([pending] * 4, [])
    shut = (False, "frozen", "frozen_outside")
    assert prediction(spark, [ROW]) == ([(True, "available", "verified_window"), shut, shut, pending], [])
    available = ROW[:4] + ("available", "ok", "report", "2026-09-16")
    assert prediction(spark, [available])[0][1] == (False, "unavailable", "ok")
    faults = {
        "ambiguous_zero_window": ROW[:3] + ("00:00-00:00",) + ROW[4:], "invalid_id_or_date": (2, "7") + ROW[2:], "invalid_enum": (2, "39", "monday") + ROW[3:], "missing_evidence": ROW[:6] + ("", "2026-09-16"),
        "missing_windows": ROW[:3] + ("", "available") + ROW[5:], "status_conflict": ROW[:4] + ("dead_feed",) + ROW[5:],
    }
    for code, row in faults.items():
        got, codes = prediction(spark, [(1, "40") + ROW[2:], row])
        assert got == [pending] * 4 and (2, code) in codes
    assert prediction(spark, [ROW, (3,) + ROW[1:]]) == ([pending] * 4, [(3, "duplicate_rule")])


def test_holidays_pick_the_group_of_sundays(spark):
    rules, _ = gates.prediction_rules(spark.createDataFrame([(2, "39", "sunday_holiday", "09:00-17:00", "available", "ok", "r", "2026-09-16")], GATE), lots(spark))
    asked = spark.createDataFrame([(39, datetime(2026, 9, 16, 10))], "lot long, a timestamp_ntz")
    assert [gates.prediction_check(asked, rules, "a", "a", *[F.lit(h)] * 2).first()["allowed"] for h in (True, False)] == [True, False]


def test_accessibility_is_three_valued(spark):
    df = spark.createDataFrame([(None, False, 60), ([(0, 100)], False, 60), ([(0, 50)], False, 60), ([(0, 50)], True, 60), ([], None, 60)], "xs array<struct<s:int,e:int>>, night boolean, m int")
    assert [r[0] for r in df.select(gates.open_state(F.col("xs"), F.col("night"), F.col("m"))).collect()] == [None, True, False, True, False]


def test_texts_parsed_once_a_batch_are_those_of_the_columns(spark):
    texts = ["", "closed", "09:00-18:00", "13:00-18:00|09:00-12:00", "10:00-12:00|11:00-13:00", "24:00-24:00", "00:00-24:00", "23:00-24:01", "9:00-10:00", "09:00-18:00|", "08:00-25:00", "22:00-06:00", "09:00-09:00", "09:60-10:00", "06:00-10:00\n", "x|09:00-09:00", "09:00-10:00|10:00-11:00"]
    days = ["", "2024-02-29", "2024-02-30", "2023-02-29", "0001-01-01", "9999-12-31", "2024/01/01", "2024-1-01", "2024-13-01", "2024-01-01\n", "2024-00-10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for closed in (True, False):
        for r in df.select("t", ru.windows(F.col("t"), closed).alias("w")).collect():
            assert ru.parsed_windows(r["t"], closed) == r["w"].asDict(True), r
    for r in spark.createDataFrame([(t,) for t in days], "t string").select("t", F.unix_date(ru.day(F.col("t"))).alias("d")).collect():
        assert ru.parsed_day(r["t"]) == r["d"], r


def test_sound_rows_are_those_of_no_issue_and_no_row_is_parsed_for_each_check(spark):
    from occuflow.plans import rules as plan
    from occuflow.sources.tables import lots as known

    d = "/root/testdata/sf0.001"
    rows = plan.rule_rows(spark, d)
    rows = rows.union(rows.where("line % 7 = 0").withColumn("name", F.lit("other")))  # lines that two rows share
    want = ru.typed(rows, known(spark, d)).join(ru.validate(rows, known(spark, d)).select("line").distinct(), "line", "left_anti").select("line", "day_group")
    got = ru.sound(rows, known(spark, d)).select("line", "day_group")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    shown = spark._jvm.PythonSQLUtils.explainString(ru.validate(rows, known(spark, d))._jdf.queryExecution(), "simple").split("== Physical Plan ==")[-1]
    assert "transform(split(" not in shown and shown.count("MapInArrow") == 3  # the rows, both windows together, and the groups
