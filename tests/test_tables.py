"""Queries on the plain tables."""

import pyarrow as pa
import pyarrow.parquet as pq

from occuflow import catalogue


def test_rounded_sums_add_up_in_the_order_of_rows(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for name, values in (("a", [1e16]), ("b", [1.0, 1.0, None])):  # 1e16 + 1 is 1e16: in parts, the sum would end in 2
        table = pa.table({"user_id": pa.array([1] * len(values) + [2], pa.int64()), "value": pa.array([*values, None if name == "a" else 2.5], pa.float64())})
        pq.write_table(table, folder / f"{name}.parquet")
    got = {r["user_id"]: (r["half_even"], r["hundreds"], r["tens"]) for r in catalogue.queries()["scalar_functions"](spark, str(tmp_path)).collect()}
    assert got == {1: (10**16, 10**16, 1), 2: (2, 0, 1)}
