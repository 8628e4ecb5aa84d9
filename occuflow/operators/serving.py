"""What is served for a candidate: the first reason against a forecast, access to a stay, and the cheapest of the benefits held."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tariff
from .intervals import contains, first_gap


def snapped(minutes: Column, grid: tuple[int, ...]) -> Column:
    """The nearest served horizon, the shorter of two as near."""
    return F.array_min(F.array(*[F.struct(F.abs(F.lit(g).cast("long") - minutes).alias("d"), F.lit(g).cast("long").alias("g")) for g in grid]))["g"]


def ladder(supported: Column, live: Column, model: Column, gate: Column, certified: Column, fresh: Column, whole: Column) -> Column:
    """``ml``, or the first reason why there is no forecast: the horizon, a dead feed, no model, the gate (null if open), the accuracy of the lot, the age of what was seen, missing features.

    An unknown answer to a question counts as a no.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(supported), "unsupported_horizon").when(no(live), "dead_feed").when(no(model), "no_model").when(gate.isNotNull(), gate).when(no(certified), "lot_horizon_not_certified").when(no(fresh), "no_fresh_history").when(no(whole), "missing_features").otherwise("ml")
    )


def access(public: Column, windows: Column, arrive: Column, leave: Column, margin: int) -> Column:
    """(reason, status, closes_at) of a stay in minutes from a day's start: the first reason against it, and the end of the window that it leaves in.

    A lot without known windows is ``unknown``; one that isn't for everybody says nothing of its hours.
    """
    at = F.pmod(leave, F.lit(1440))
    last = F.filter(windows, lambda x: (at >= x["s"]) & (at < x["e"]))
    close = F.try_element_at(last, F.lit(1))["e"]
    reason = (
        F.when(~public, "general_public_not_allowed").when(windows.isNull(), "access_schedule_unknown").when(~contains(windows, arrive), "entry_closed_at_arrival").when(F.size(last) == 0, "closes_before_departure")
        .when((at + margin >= close) & (close < 1440), "insufficient_exit_margin").when(first_gap(windows, arrive, leave).isNotNull(), "closed_interval_crossed").otherwise("available")
    )
    status = F.when(reason == "available", "confirmed_open").when(reason == "access_schedule_unknown", "unknown").otherwise("confirmed_restricted")
    return F.struct(reason.alias("reason"), status.alias("status"), F.when(public & windows.isNotNull(), close).alias("closes_at"))


def cheapest(minutes: Column, prices: Column, held: Callable[[int], Column]) -> Column:
    """(total, pos, code): the least total over all discounts that ``held(i)`` says are held, and none at all; ties go to the first, and unpriced stays stay so."""

    def one(i: int, code: str) -> Column:
        percent, free = tariff.DISCOUNTS.get(code, (100, 0))
        due = F.greatest(minutes - free, F.lit(0))
        total = F.when(prices.isNull(), None).when(due == 0, 0).otherwise(F.floor(F.least(tariff.progressive(due, prices), F.lit(tariff.DAY_CAP)) * percent / 10_000) * 100).cast("long")
        return F.struct(total.isNull().alias("none"), total.alias("total"), F.lit(i).alias("pos"), F.lit(code).alias("code"))

    options = [one(0, "none"), *[F.when(held(i), one(i + 1, c)) for i, c in enumerate(tariff.DISCOUNTS)]]
    return F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))
