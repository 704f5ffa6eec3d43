"""Decisions and the purchases that resolve them, with equal times."""

import datetime

from heddle.plans import buffers


def test_a_purchase_at_the_same_time_resolves_nothing(spark, tmp_path):
    at = lambda h, m=0, d=1: datetime.datetime(2024, 1, d, h, m)
    rows = [(1, 1, "signup", at(0)), (2, 1, "purchase", at(0)), (3, 1, "purchase", at(5)), (4, 2, "purchase", at(1)), (5, 2, "signup", at(1)), (6, 2, "signup", at(1)), (7, 3, "signup", at(2)), (8, 3, "purchase", at(3, 0, 2)), (9, None, "signup", at(2)), (10, None, "purchase", at(3)), (11, 4, "signup", at(2)), (12, 4, "purchase", at(2, 0, 2))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["resolved_at"], r["status"]) for r in buffers.outcome_lifecycle(spark, str(tmp_path)).collect()}
    assert got == {1: (at(5), "resolved"), 5: (None, "expired"), 6: (None, "expired"), 7: (None, "expired"), 9: (None, "expired"), 11: (at(2, 0, 2), "resolved")}
