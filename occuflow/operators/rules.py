"""Validation of access rules: one pass gives every row's typed values and coded issues, then sets of rows are checked by group.

A rule row is all text, as a file has it. Nothing is dropped or guessed: an issue names its line, column and code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import KIND

#: Columns of a rule file in their order, and the words that they may hold.
FIELDS = (
    "parking_id", "name", "day_group", "entry_windows", "exit_windows", "fee_windows", "fee_mode", "overnight_allowed", "access_status",
    "general_public", "effective_from", "effective_to", "checked_at", "evidence_method", "evidence_ref", "note",
)
DAY_GROUPS = ("weekday", "saturday", "sunday_holiday")
STATUSES = ("confirmed_open", "confirmed_restricted", "unknown")
FEE_MODES = ("paid_window_free_outside", "paid_24h", "free", "closed", "unknown")
METHODS = ("official_web", "phone", "field", "user_experience")

CONFIRMED = "access_status IN ('confirmed_open', 'confirmed_restricted')"


def words(xs: tuple[str, ...]) -> str:
    return "({})".format(", ".join(f"'{x}'" for x in xs))


#: (column, code, condition) of the checks of a row, in SQL over its texts and typed values.
CHECKS = [
    ("row", "extra_values", "extra"),
    ("parking_id", "invalid_parking_id", "pid IS NULL"),
    ("name", "required", "name = ''"),
    ("parking_id", "unknown_parking_id", "pid IS NOT NULL AND lot_name IS NULL"),
    ("name", "parking_name_mismatch", "name <> '' AND lot_name IS NOT NULL AND name <> lot_name"),
    ("day_group", "invalid_enum", f"day_group NOT IN {words(DAY_GROUPS)}"),
    ("access_status", "invalid_enum", f"access_status NOT IN {words(STATUSES)}"),
    ("fee_mode", "invalid_enum", f"fee_mode NOT IN {words(FEE_MODES)}"),
    ("overnight_allowed", "invalid_boolean", "overnight_allowed NOT IN ('true', 'false')"),
    ("general_public", "invalid_boolean", "general_public NOT IN ('true', 'false')"),
    ("access_status", "unknown_with_access_hours", "access_status = 'unknown' AND (entry_windows <> '' OR exit_windows <> '')"),
    ("access_status", "confirmed_without_access_hours", "access_status <> 'unknown' AND (entry_n IS NULL OR exit_n IS NULL)"),
    ("access_status", "open_but_closed", "access_status = 'confirmed_open' AND (entry_n = 0 OR exit_n = 0)"),
    ("fee_windows", "fee_mode_conflict", "CASE WHEN fee_mode IN ('free', 'closed', 'unknown') AND fee_windows <> '' THEN TRUE WHEN fee_mode = 'paid_24h' THEN NOT fee_whole WHEN fee_mode = 'paid_window_free_outside' THEN coalesce(fee_n, 0) = 0 ELSE FALSE END"),
    ("effective_from", "required", "effective_from = ''"),
    ("effective_from", "invalid_date", "effective_from <> '' AND starts IS NULL"),
    ("effective_to", "invalid_date", "effective_to <> '' AND ends IS NULL"),
    ("checked_at", "required", f"checked_at = '' AND {CONFIRMED}"),
    ("checked_at", "invalid_date", "checked_at <> '' AND checked IS NULL"),
    ("effective_to", "invalid_date_range", "ends < starts"),
    ("evidence_method", "invalid_enum", f"evidence_method <> '' AND evidence_method NOT IN {words(METHODS)}"),
    ("evidence_method", "required", f"evidence_method = '' AND {CONFIRMED}"),
    ("evidence_ref", "required", f"evidence_ref = '' AND {CONFIRMED}"),
]


def windows(text: Column, closed: bool) -> Column:
    """(code, xs) of ``HH:MM-HH:MM|...``: the sorted windows, or the code of the first fault. Empty text is a null; ``closed`` no window, where it is allowed."""

    def minute(token: Column, at: int, end: bool) -> Column:
        h, m = (F.substring(token, at + k, 2).try_cast("int") for k in (0, 3))
        return F.when((h < 24) & (m < 60) | (F.lit(end) & (h == 24) & (m == 0)), h * 60 + m)

    def one(token: Column) -> Column:
        s, e = minute(token, 1, False), minute(token, 7, True)
        code = F.when(~F.regexp_like(token, F.lit(r"^[0-9]{2}:[0-9]{2}-[0-9]{2}:[0-9]{2}\z")), "invalid_window").when(s.isNull() | e.isNull(), "invalid_time").when(s == e, "ambiguous_zero_window").when(s > e, "cross_midnight_window")
        return F.struct(code.alias("code"), s.alias("s"), e.alias("e"))

    def whole(xs: Column) -> Column:
        fault = F.try_element_at(F.filter(F.transform(xs, lambda x: x["code"]), lambda c: c.isNotNull()), F.lit(1))
        good = F.array_sort(F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        meets = F.exists(F.zip_with(F.slice(good, 1, F.size(good) - 1), F.slice(good, 2, F.size(good)), lambda a, b: b["s"] < a["e"]), lambda x: x)
        code = F.when(fault.isNotNull(), fault).when(meets, "overlapping_windows")
        return F.struct(code.alias("code"), F.when(code.isNull(), good).cast(KIND).alias("xs"))

    parsed = F.transform(F.array(F.transform(F.split(text, "\\|", -1), one)), whole)[0]
    none, empty = F.lit(None).cast(KIND), F.array().cast(KIND)
    shut = F.struct(F.lit(None if closed else "closed_not_allowed").cast("string").alias("code"), (empty if closed else none).alias("xs"))
    return F.when(text == "", F.struct(F.lit(None).cast("string").alias("code"), none.alias("xs"))).when(text == "closed", shut).otherwise(parsed)


def day(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")), text.try_cast("date"))


WINDOW = pa.struct([("code", pa.string()), ("xs", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])
TYPED = f"line {{line}}, extra boolean, {', '.join(f'{c} string' for c in FIELDS)}, pid long, " + ", ".join(f"{c} struct<code: string, xs: {KIND}>" for c in ("entry", "exit", "fee")) + ", starts date, ends date, checked date"


def parsed_windows(text: str, closed: bool) -> dict:
    """``windows`` of one text."""
    if text in ("", "closed"):
        return {"code": "closed_not_allowed" if text and not closed else None, "xs": [] if text and closed else None}
    xs = []
    for token in text.split("|"):
        if not re.fullmatch(r"[0-9]{2}:[0-9]{2}-[0-9]{2}:[0-9]{2}", token):
            return {"code": "invalid_window", "xs": None}
        h, m, h2, m2 = (int(token[i : i + 2]) for i in (0, 3, 6, 9))
        if h > 23 or m > 59 or m2 > 59 or h2 > 23 and (h2, m2) != (24, 0):
            return {"code": "invalid_time", "xs": None}
        s, e = h * 60 + m, h2 * 60 + m2
        if s >= e:
            return {"code": "ambiguous_zero_window" if s == e else "cross_midnight_window", "xs": None}
        xs.append((s, e))
    xs.sort()
    if any(b[0] < a[1] for a, b in zip(xs, xs[1:])):
        return {"code": "overlapping_windows", "xs": None}
    return {"code": None, "xs": [{"s": s, "e": e} for s, e in xs]}


def parsed_day(text: str) -> int | None:
    """``day`` of one text, as days since 1970."""
    try:
        return int(np.datetime64(text, "D").astype(np.int64)) if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text) else None
    except ValueError:
        return None


def parsed_id(text: str) -> int | None:
    return int(text) or None if re.fullmatch(r"\+?[0-9]{1,18}", text) else None


def each_once(texts: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of every text, called once a distinct text of the batch."""
    coded = texts.dictionary_encode()
    return pa.array([f(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)


def typed(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """Rule rows (line, the fields, maybe ``extra``) with their typed values; rows without any value are passed over. ``lots`` has (lot, name).

    A rule table repeats few texts, so each is parsed once a batch.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            text = {c: each_once(pc.fill_null(t.column(c), ""), lambda x: x.strip(" "), pa.string()) for c in FIELDS}
            made = {"line": t.column("line"), "extra": t.column("extra"), **text, "pid": each_once(text["parking_id"], parsed_id, pa.int64())}
            for c in ("entry", "exit", "fee"):
                made[c] = each_once(text[f"{c}_windows"], lambda x, closed=c != "fee": parsed_windows(x, closed), WINDOW)
            for c, n in (("effective_from", "starts"), ("effective_to", "ends"), ("checked_at", "checked")):
                made[n] = each_once(text[c], parsed_day, pa.date32())
            some = reduce(pc.or_, [pc.not_equal(x, "") for x in text.values()])
            yield pa.RecordBatch.from_pydict(made).filter(some)

    extra = F.coalesce(F.col("extra"), F.lit(False)) if "extra" in rows.columns else F.lit(False)
    text = rows.select("line", extra.alias("extra"), *[F.col(c).cast("string").alias(c) for c in FIELDS])
    x = text.mapInArrow(parse, TYPED.format(line=dict(rows.dtypes)["line"]))
    count = lambda c: F.when(F.col(c)["xs"].isNotNull(), F.size(F.col(c)["xs"]))
    whole = F.coalesce((F.size("fee.xs") == 1) & (F.try_element_at("fee.xs", F.lit(1))["s"] == 0) & (F.try_element_at("fee.xs", F.lit(1))["e"] == 1440), F.lit(False))
    x = x.withColumns({"entry_n": count("entry"), "exit_n": count("exit"), "fee_n": count("fee"), "fee_whole": whole})
    return x.join(lots.select(F.col("lot").cast("long").alias("pid"), F.col("name").alias("lot_name")), "pid", "left")


def fails() -> Column:
    """Whether a typed row fails any check of its own."""
    out = F.lit(False)
    for when in [F.expr(when) for _, _, when in CHECKS] + [F.col(c)["code"].isNotNull() for c in ("entry", "exit", "fee")]:
        out = out | F.coalesce(when, F.lit(False))
    return out


def sound(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """Typed rows of the lines without an issue. Rows that fail a check of their own are left out before lines are compared, and issues aren't listed for it."""
    x = typed(rows, lots).withColumn("fails_", fails())
    bad = x.where("fails_").select("line").union(set_issues(x).select("line"))
    return x.where("NOT fails_").drop("fails_").join(bad, "line", "left_anti")


def row_issues(x: DataFrame) -> DataFrame:
    """(line, column, code) of every check that a typed row fails."""
    issue = lambda column, code, when: F.when(when, F.struct(F.lit(column).alias("column"), code.alias("code")))
    parsed = [issue(f"{c}_windows", F.col(c)["code"], F.col(c)["code"].isNotNull()) for c in ("entry", "exit", "fee")]
    every = F.array(*[issue(column, F.lit(code), F.expr(when)) for column, code, when in CHECKS], *parsed)
    return x.select("line", F.explode(F.filter(every, lambda i: i.isNotNull())).alias("i")).select("line", "i.column", "i.code")


def set_issues(x: DataFrame) -> DataFrame:
    """Issues of rows together: a day group twice or missing in a lot's period, and periods of a lot and day group that overlap."""
    known = x.where(F.col("pid").isNotNull() & F.col("day_group").isin(*DAY_GROUPS) & F.col("starts").isNotNull()).select("line", "pid", "day_group", "starts", "ends")
    groups = known.groupBy("pid", "starts", "ends").agg(F.countDistinct("day_group").alias("n"), F.min("line").alias("line"))
    missing = groups.where(F.col("n") < len(DAY_GROUPS)).select("line", F.lit("day_group").alias("column"), F.lit("missing_day_groups").alias("code"))
    # both windows from one shuffle: the groups of the first lie within those of the second
    nth = F.row_number().over(Window.partitionBy("pid", "starts", "ends", "day_group").orderBy("line"))
    order = Window.partitionBy("pid", "day_group").orderBy("starts", "line")
    placed = known.withColumns({"first": F.row_number().over(order) == 1, "last": F.coalesce(F.lag("ends").over(order), F.lit("9999-12-31").cast("date"))}).withColumn("nth", nth)
    issue = lambda column, code, when: F.when(when, F.struct(F.lit(column).alias("column"), F.lit(code).alias("code")))
    both = F.array_compact(F.array(issue("day_group", "duplicate_day_group", F.col("nth") > 1), issue("effective_from", "overlapping_effective_periods", ~F.col("first") & (F.col("starts") <= F.col("last")))))
    of_rows = placed.select("line", F.explode(both).alias("i")).select("line", "i.column", "i.code")
    return of_rows.union(missing)


def validate(rows: DataFrame, lots: DataFrame) -> DataFrame:
    """(line, column, code) of all issues of rule rows."""
    x = typed(rows, lots)
    return row_issues(x).union(set_issues(x))
