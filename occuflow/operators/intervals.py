"""Windows of minutes as sorted arrays of (s, e), half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<s:int,e:int>>"


def minute_of(text: Column, end: bool = False) -> Column:
    """Minutes of ``HH:MM``; null unless it is a time, 24:00 only as an end."""
    h, m = (F.try_to_number(F.regexp_extract(text, r"^(\d{2}):(\d{2})$", k), F.lit("99")).cast("int") for k in (1, 2))
    out = h * 60 + m
    good = (m < 60) & ((out < 1440) | ((out == 1440) & F.lit(end)))
    return F.when(good, out)


def parse(text: Column) -> Column:
    """``HH:MM-HH:MM|...`` to an array; ``closed`` is empty, a wrong window makes the whole null."""
    one = lambda w: F.struct(minute_of(F.split(w, "-")[0]).alias("s"), minute_of(F.try_element_at(F.split(w, "-"), F.lit(2)), True).alias("e"))
    xs = F.transform(F.split(text, "\\|"), one)
    wrong = F.exists(xs, lambda x: x["s"].isNull() | x["e"].isNull() | (x["s"] >= x["e"]))
    return F.when(text == "closed", F.array().cast(KIND)).when(~wrong, F.array_sort(xs)).cast(KIND)


def merged(xs: Column) -> Column:
    """The union of windows; touching ones join."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), longer).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(xs), F.array().cast(KIND), step)


def contains(xs: Column, minute: Column) -> Column:
    return F.exists(xs, lambda x: (minute >= x["s"]) & (minute < x["e"]))


def first_gap(xs: Column, start: Column, end: Column) -> Column:
    """The first minute of [start, end) that no window has, else null."""
    at = F.aggregate(F.array_sort(xs), start, lambda acc, x: F.when((x["s"] <= acc) & (x["e"] > acc), x["e"]).otherwise(acc))
    return F.when(at < end, at)


def text(xs: Column) -> Column:
    part = lambda m: F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))
    return F.array_join(F.transform(xs, lambda x: F.concat(part(x["s"]), F.lit("-"), part(x["e"]))), "|")
