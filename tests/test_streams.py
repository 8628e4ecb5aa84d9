import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from occuflow.plans.stream import STEP
from occuflow.streaming import live, windows

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def parts():
    """Three files, 90 days apart each, with rows that repeat and slots that several rows share."""
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), "view" if i % 3 else "click", START + timedelta(days=90 * (i % 3), minutes=rng.randrange(7000)), float(rng.randrange(1, 90))) for i in range(600)]
    files = [[r for r in rows if r[0] % 3 == k] for k in range(3)]
    files[0] += files[2][:20]  # polls again, in another file
    return [pd.DataFrame(f, columns=["event_id", "user_id", "event_type", "ts", "value"]) for f in files]


def written(folder, parts, order):
    """Files that the stream meets in this order."""
    folder = folder / "events.parquet"
    folder.mkdir(parents=True)
    for k, i in enumerate(order):
        path = folder / f"part-{i}.parquet"
        parts[i].astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + 100 * k,) * 2)
    return str(folder.parent)


def all_rows(parts):
    return pd.concat(parts).drop_duplicates("event_id")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_no_row_is_lost_in_any_order_of_batches(spark, tmp_path, parts, order):
    d, rows = written(tmp_path, parts, order), all_rows(parts)
    got = windows.tumbling(spark, d, "6 hours", per_batch=1).toPandas()
    assert got["n"].sum() == len(rows) and got["total"].sum() == pytest.approx(rows["value"].sum())
    want = rows.groupby(["event_type", rows["ts"].dt.floor("6h")]).size()
    assert {(r.event_type, r.start): r.n for r in got.itertuples()} == want.to_dict()
    assert windows.sliding(spark, d, "12 hours", "3 hours", per_batch=1).toPandas()["n"].sum() == 4 * len(rows)
    sessions = windows.sessions(spark, d, "4 hours", per_batch=1).toPandas()
    s = rows.sort_values(["user_id", "ts"])
    breaks = (s.groupby("user_id")["ts"].diff() >= pd.Timedelta("4h")) | (s["user_id"] != s["user_id"].shift())
    assert sessions["n"].sum() == len(rows) and len(sessions) == breaks.sum()


def test_a_fixed_lateness_loses_what_is_later(spark, tmp_path, parts):
    d = written(tmp_path, parts, (2, 1, 0))
    assert windows.tumbling(spark, d, "6 hours", "1 day", per_batch=1).toPandas()["n"].sum() < len(all_rows(parts))


def expected(parts):
    out = {}
    for lot, g in all_rows(parts).groupby("user_id"):
        slot = (g["ts"] - datetime(1970, 1, 1)) // pd.Timedelta(minutes=STEP)
        by = {s: x.sort_values(["ts", "event_id"])["value"].iloc[-1] for s, x in g.groupby(slot)}
        last = max(by)
        by = {s: v for s, v in by.items() if s > last - live.SLOTS}
        mean = lambda w: sum(v for s, v in by.items() if s > last - w) / sum(s > last - w for s in by)
        out[lot] = (last, len(by), by[last], *(by.get(last - k) for k in live.LAGS), *(mean(w) for w in live.MEANS))
    return out


def rows_of(df):
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(minutes=STEP)
    return {r["lot"]: (us(r["last_slot"]), *tuple(r)[2:-1]) for r in df.collect()}


@pytest.mark.parametrize(("order", "per_batch"), [((0, 1, 2), None), ((0, 1, 2), 1), ((2, 0, 1), 1), ((1, 2, 0), 2)])
def test_state_equals_the_batch_in_any_order(spark, tmp_path, parts, order, per_batch):
    got = rows_of(live.live(spark, written(tmp_path, parts, order), STEP, per_batch))
    want = expected(parts)
    assert got.keys() == want.keys()
    for lot, w in want.items():
        assert got[lot] == pytest.approx(w)


def test_state_goes_on_after_a_restart(spark, tmp_path, parts, monkeypatch):
    """The second run meets only the new file, and starts from the state that the first one wrote."""
    work = (tmp_path / "work").as_uri()
    monkeypatch.setattr(windows, "work_folder", lambda spark: work)
    d = written(tmp_path, parts[1:], (1, 0))
    live.live(spark, d, STEP).count()
    path = tmp_path / "events.parquet" / "later.parquet"
    parts[0].astype({"ts": "datetime64[us]"}).to_parquet(path, index=False)
    got = rows_of(live.live(spark, d, STEP))
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in expected(parts).items()}
    batches = sorted(p.name for p in (tmp_path / "work" / "out").iterdir() if p.name.startswith("batch"))
    assert batches == ["batch=0", "batch=1"]


def test_ready_needs_fresh_and_whole_numbers(spark, tmp_path):
    rows = [(i, lot, "view", START + timedelta(minutes=STEP * s), 1.0 * s) for i, (lot, s) in enumerate([(1, s) for s in range(20)] + [(2, s) for s in range(17)] + [(3, 19)] + [(4, s) for s in range(1, 19)])]
    d = written(tmp_path, [pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "ts", "value"])], (0,))
    got = {r["lot"]: (r["ready"], r["slots"], r["lag_12"]) for r in live.live(spark, d, STEP).collect()}
    assert got == {1: (True, 13, 7.0), 2: (False, 13, 4.0), 3: (False, 1, None), 4: (True, 13, 6.0)}
