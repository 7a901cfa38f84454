from datetime import datetime, timedelta

from silolake.operators.rounds import round_updates

T0 = datetime(2024, 1, 1)
UPD = ("round int, silo_id string, base_version int, delta array<double>, n_samples long, train_loss double, "
       "wall_time_s double, arrived_at timestamp")


def _u(r, silo, sec):
    return (r, silo, r, [1.0, 2.0], 100, 0.1, 1.0, T0 + timedelta(seconds=sec))


def test_round_updates_hand_computed(spark):
    # 3 registered silos → quorum ⌈0.6·3⌉ = 2; rounds open every 600 s, deadline after 480 s, extension +240 s
    rounds = spark.createDataFrame([(0, T0, T0 + timedelta(seconds=480)),
                                    (1, T0 + timedelta(seconds=600), T0 + timedelta(seconds=1080))],
                                   "round int, start_ts timestamp, deadline timestamp")
    silos = spark.createDataFrame([("s0", 10), ("s1", 10), ("s2", 10)], "silo_id string, n_rows long")
    upd = spark.createDataFrame([
        _u(0, "s0", 100), _u(0, "s0", 150),   # resubmission: the later one wins, still on time
        _u(0, "s1", 200),
        _u(0, "s2", 500),                     # after round 0 closed at 480 → carried into round 1
        _u(0, "s9", 100),                     # not registered
        _u(1, "s0", 700),                     # round 1: only one on time → extended to 1320
        _u(1, "s1", 1150),                    # inside the extension
        _u(1, "s2", 1400),                    # after the extension and no round 2 → dropped
    ], UPD)
    got = {(r["agg_round"], r["silo_id"], r["src_round"], r["staleness"], r["weight"],
            int((r["arrived_at"] - T0).total_seconds()))
           for r in round_updates(upd, rounds, silos).collect()}
    assert got == {
        (0, "s0", 0, 0, 1.0, 150), (0, "s1", 0, 0, 1.0, 200),
        (1, "s0", 1, 0, 1.0, 700), (1, "s1", 1, 0, 1.0, 1150), (1, "s2", 0, 1, 0.5, 500),
    }


def test_late_resubmission_keeps_the_update_in_time(spark):
    """A silo that resubmits after the close still counts with what it sent in time; the copy goes to the next round."""
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rounds = spark.createDataFrame([(1, at(0), at(480)), (2, at(600), at(1080))], "round int, start_ts timestamp, deadline timestamp")
    silos = spark.createDataFrame([("a", 10), ("b", 10)], "silo_id string, n_rows long")
    row = lambda r, s, t: (r, s, 0, [float(t)], 1, 0.0, 0.0, at(t))
    updates = spark.createDataFrame([row(1, "a", 100), row(1, "a", 500), row(1, "b", 200), row(2, "a", 700), row(2, "b", 800)],
                                    "round int, silo_id string, base_version int, delta array<double>, n_samples int, train_loss double, "
                                    "wall_time_s double, arrived_at timestamp")
    got = {(r["agg_round"], r["src_round"], r["silo_id"], r["delta"][0], r["weight"]) for r in round_updates(updates, rounds, silos).collect()}
    assert got == {(1, 1, "a", 100.0, 1.0), (1, 1, "b", 200.0, 1.0), (2, 1, "a", 500.0, 0.5), (2, 2, "a", 700.0, 1.0), (2, 2, "b", 800.0, 1.0)}
