"""Progressive tariffs of stays, day passes and discounts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices of the first half hour, then of each ten minutes up to 60, 120, 180 minutes and beyond, by kind and grade.
RATES = {
    ("on", 1): (600, 300, 600, 900, 1200), ("on", 2): (400, 200, 400, 600, 800), ("on", 3): (200, 100, 300, 400, 400),
    ("off", 1): (600, 300, 600, 900, 1200), ("off", 2): (400, 200, 400, 600, 800), ("off", 3): (200, 100, 300, 400, 400), ("off", 4): (200, 100, 200, 200, 200), ("off", 5): (200, 100, 100, 100, 100),
}
#: Day passes by whole hours and grade 1 to 5.
PASSES = {
    8: (10000, 7000, 5000, 2000, 1500), 9: (11000, 8000, 5000, 2000, 1500), 10: (13000, 9000, 6000, 3000, 2500),
    11: (14000, 10000, 7000, 3000, 2500), 12: (15000, 11000, 7000, 3000, 2500), 13: (16000, 12000, 8000, 4000, 3500),
}
#: Percent paid and free minutes of each discount.
DISCOUNTS = {
    "emergency": (0, 0), "compact": (50, 0), "low_emission": (50, 0), "charging": (50, 120), "senior": (50, 0), "disabled_mild": (50, 0), "disabled_severe": (50, 120),
    "veteran": (50, 120), "transfer": (50, 0), "transfer_compact": (40, 0), "children": (50, 0), "pregnant": (50, 0), "market": (100, 90),
}
#: Percent of a day pass that holders of a discount pay.
PASS_PERCENT = 30
BRACKETS = ((30, 60), (60, 120), (120, 180), (180, 1440))
DAY_CAP, FREE_MINUTES = 25_000, 15


def rates(kind: Column, grade: Column) -> Column:
    """The five prices of a kind and grade as an array, null for others."""
    out = F.lit(None).cast("array<int>")
    for (k, g), row in RATES.items():
        out = F.when((kind == k) & (grade == g), F.array(*map(F.lit, row))).otherwise(out)
    return out


def progressive(minutes: Column, prices: Column) -> Column:
    """Price of billable minutes: the first half hour is flat, then each begun ten minutes by bracket."""
    total = F.when(minutes > 0, F.element_at(prices, 1)).otherwise(0)
    for i, (lo, hi) in enumerate(BRACKETS, 2):
        total = total + F.ceil(F.greatest(F.least(minutes, F.lit(hi)) - lo, F.lit(0)) / 10) * F.element_at(prices, i)
    return total.cast("long")


def day_pass(hours: Column, grade: Column) -> Column:
    out = F.lit(None).cast("int")
    for h, row in PASSES.items():
        out = F.when(hours == h, F.element_at(F.array(*map(F.lit, row)), grade.cast("int"))).otherwise(out)
    return out


def schedule(start: Column, minutes: Column, open_minute: Column, close_minute: Column) -> Column:
    """For each calendar day of a stay: (day, billable), its minutes inside the day's charging window; ``start`` counts minutes from 1970."""
    first, last = F.floor(start / 1440), F.floor((start + minutes - 1) / 1440)
    return F.transform(
        F.sequence(first, last),
        lambda day: F.struct(day.alias("day"), F.greatest(F.least(start + minutes, day * 1440 + close_minute) - F.greatest(start, day * 1440 + open_minute), F.lit(0)).cast("long").alias("billable")),
    )


def after_free(days: Column, free: Column) -> Column:
    """Free minutes are used up from the first paid day on."""
    start = F.struct(free.cast("long").alias("left"), F.array().cast("array<struct<day:bigint,billable:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        used = F.least(acc["left"], x["billable"])
        return F.struct((acc["left"] - used).alias("left"), F.concat(acc["out"], F.array(F.struct(x["day"].alias("day"), (x["billable"] - used).alias("billable")))).alias("out"))

    return F.aggregate(days, start, step, lambda acc: acc["out"])


def total(days: Column, prices: Column, percent_paid: Column) -> Column:
    """The stay's price: nothing below fifteen billable minutes, a cap for each day, the discount, then down to hundreds."""
    billable = F.aggregate(days, F.lit(0).cast("long"), lambda a, x: a + x["billable"])
    sum_ = F.aggregate(days, F.lit(0).cast("long"), lambda a, x: a + F.least(progressive(x["billable"], prices), F.lit(DAY_CAP)))
    return F.when(billable < FREE_MINUTES, 0).otherwise(F.floor(sum_ * percent_paid / 100 / 100) * 100).cast("long")


def break_even(pass_price: Column, prices: Column) -> Column:
    """The first minute from which the pass is cheaper, null if never within a day."""
    hit = F.filter(F.sequence(F.lit(10), F.lit(1440), F.lit(10)), lambda m: progressive(m, prices) > pass_price)
    return F.when(pass_price.isNotNull(), F.try_element_at(hit, F.lit(1)) - 9)


def discount(code: Column, part: int) -> Column:
    """Percent paid (part 0) or free minutes (part 1) of a discount; without one all is paid from the first minute."""
    out = F.lit((100, 0)[part])
    for name, row in DISCOUNTS.items():
        out = F.when(code == name, row[part]).otherwise(out)
    return out


def weekday_of(day: Column) -> Column:
    """Monday is 0; days count from 1970."""
    return F.pmod(day + 3, F.lit(7))


def charged_days(start: Column, minutes: Column, windows: Column, free_days: Column) -> Column:
    """For each calendar day of a stay: (day, billable, window), its minutes inside the charging windows (s, e) of the day and the windows' length.

    Windows are given by weekday, an array of seven arrays; on free days, and outside all windows, nothing is charged.
    """
    first, last = F.floor(start / 1440), F.floor((start + minutes - 1) / 1440)

    def of(day: Column) -> Column:
        mine = F.when(F.array_contains(free_days, day), F.array().cast("array<struct<s:int,e:int>>")).otherwise(F.element_at(windows, (weekday_of(day) + 1).cast("int")))
        inside = lambda a, w: a + F.greatest(F.least(start + minutes, day * 1440 + w["e"]) - F.greatest(start, day * 1440 + w["s"]), F.lit(0))
        zero = F.lit(0).cast("long")
        return F.struct(day.alias("day"), F.aggregate(mine, zero, inside).alias("billable"), F.aggregate(mine, zero, lambda a, w: a + w["e"] - w["s"]).alias("window"))

    return F.transform(F.sequence(first, last), of)


def once(values: list[Column], use: Callable[..., Column]) -> Column:
    """``use`` of values that are computed once a row, however often it names them; its result isn't taken apart into copies of it."""
    row = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(row), lambda x: use(*[x[f"v{i}"] for i in range(len(values))])), 1)


def quote(days: Column, prices: Column, grade: Column, percent: Column, free: Column, first_minute: bool = True) -> Column:
    """A stay's quote from its charged days: each day has its own progression and cap; free minutes are used from the first paid day on; the discount comes before rounding down.

    The day pass is that of the first paid day's charging hours, null where the table has none; a prepaid total is given for stays of one paid day.
    Without ``first_minute`` the field ``pass_from_minute``, which tries a day's minutes, is left out.
    """
    zero = F.lit(0).cast("long")
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["day"].alias("day"), x["billable"].alias("billable")))
    sum_of = lambda xs, f: F.aggregate(xs, zero, lambda a, x: a + f(x))

    def sums(days_: Column, prices_: Column, left: Column) -> Column:
        priced = F.transform(left, lambda x: F.struct(x["billable"].alias("billable"), progressive(x["billable"], prices_).alias("price")))
        hours = F.try_element_at(F.filter(days_, lambda x: x["billable"] > 0), F.lit(1))["window"] / 60
        of = lambda y: F.struct(
            sum_of(days_, lambda x: x["billable"]).alias("billable"), sum_of(y, lambda x: x["billable"]).alias("due"), sum_of(y, lambda x: x["price"]).alias("raw"), sum_of(y, lambda x: F.least(x["price"], F.lit(DAY_CAP))).alias("capped"),
            F.size(F.filter(y, lambda x: x["billable"] > 0)).alias("paid"), hours.alias("hours"),
        )
        return once([priced], of)

    def rest(s: Column, prices_: Column, grade_: Column, percent_: Column) -> Column:
        charged = (s["billable"] >= FREE_MINUTES) & (s["due"] > 0) & prices_.isNotNull()
        return once([charged, F.when(charged, day_pass(s["hours"], grade_))], lambda c, pass_: fields(s, prices_, percent_, c, pass_))

    def fields(s: Column, prices_: Column, percent_: Column, charged: Column, pass_: Column) -> Column:
        total = F.when(prices_.isNull(), None).when(~charged, 0).otherwise(F.floor(s["capped"] * percent_ / 10_000) * 100).cast("long")
        paid_days = F.when(charged, s["paid"]).otherwise(0)
        prepaid = F.when(paid_days == 1, F.when(percent_ != 100, F.floor(pass_ * PASS_PERCENT / 10_000) * 100).otherwise(pass_)).cast("long")
        reason = F.when(prices_.isNull(), "no_such_tariff").when(s["billable"] < FREE_MINUTES, "not_charged").when(s["due"] == 0, "within_free_minutes").when(pass_.isNull(), "no_day_pass")
        first = [break_even(pass_, prices_).alias("pass_from_minute")] if first_minute else []
        return F.struct(
            s["billable"].alias("billable"), F.when(charged, s["raw"]).alias("raw"), (charged & (s["raw"] > s["capped"])).alias("capped"), total.alias("total"), paid_days.alias("paid_days"), pass_.alias("day_pass"), prepaid.alias("prepaid"),
            (prepaid < total).alias("buy_pass"), F.when(prepaid.isNotNull(), F.greatest(total - prepaid, zero)).alias("saving"), *first, reason.alias("reason"),
        )

    known = [days, prices, grade, percent, free]
    return once(known, lambda d, p, g, c, f: once([once([after_free(plain(d), f)], lambda left: sums(d, p, left))], lambda s: rest(s, p, g, c)))
