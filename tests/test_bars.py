from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barflow.operators import bars as B
from barflow.sources import ticks as T


def ticks(spark, rows):
    """rows: (time, action, side, size, price[, bid, ask])"""
    out = []
    for i, r in enumerate(rows):
        t, action, side, size, price = r[:5]
        bid, ask = r[5:7] if len(r) > 5 else (21000.0, 21000.5)
        out.append(("NQ", t, t + timedelta(microseconds=5), i, action, side, size, float(price), bid, ask, 10, 8, 3, 2))
    return spark.createDataFrame(out, T.TICKS)


def at(h, m, s=0):
    return datetime(2024, 7, 15, h, m, s)


def test_two_time_bars(spark):
    rows = [(at(10, 0), "A", "N", 0, 0.0), (at(10, 0, 1), "T", "A", 5, 21001), (at(10, 1), "T", "B", 3, 21000),
            (at(10, 2), "T", "A", 12, 21002), (at(10, 5), "C", "N", 0, 0.0, 21001.0, 21001.5), (at(10, 6), "T", "A", 4, 21003),
            (at(10, 7), "T", "B", 15, 21000.5, 21000.5, 21001.25)]
    one, two = B.time_bars(ticks(spark, rows), "5m").orderBy("ts_event").collect()
    assert (one.open, one.high, one.low, one.close, one.volume, one.trade_count) == (21001, 21002, 21000, 21002, 20, 3)
    assert (one.buy_volume, one.sell_volume, one.large_trade_count, one.large_buy_volume, one.large_sell_volume) == (17, 3, 1, 12, 0)
    assert (one.whale_trade_count_30, one.msg_count, one.add_count) == (0, 4, 1)
    assert (one.vap_prices, one.vap_volumes) == ([21000.0, 21001.0, 21002.0], [3, 5, 12])
    assert (two.open, two.high, two.low, two.close, two.volume, two.buy_volume, two.sell_volume) == (21003, 21003, 21000.5, 21000.5, 19, 4, 15)
    assert (two.msg_count, two.cancel_count, two.bid_price, two.ask_price) == (3, 1, 21000.5, 21001.25)
    assert (two.vap_prices, two.vap_volumes) == ([21000.5, 21003.0], [15, 4])
    assert one.bar_duration_ns == 120 * 10**9 and one.latency_mean == 5000


def test_volume_and_tick_bars(spark):
    t = ticks(spark, [(at(10, 0, i), "T", "A", 10, 21000 + i) for i in range(5)])
    assert [r.volume for r in B.volume_bars(t, 20).orderBy("ts_event").collect()] == [20, 20, 10]
    assert [r.trade_count for r in B.tick_bars(t, 2).orderBy("ts_event").collect()] == [2, 2, 1]
    whales = ticks(spark, [(at(10, 0, i), "T", s, n, 21000 + i) for i, (s, n) in enumerate((("A", 30), ("B", 35), ("A", 29)))])
    w = B.volume_bars(whales, 200).collect()[0]
    assert (w.whale_trade_count_30, w.whale_buy_volume_30, w.whale_sell_volume_30) == (2, 30, 35)
    none = ticks(spark, [(at(10, 0), "A", "N", 0, 0.0)])
    assert B.volume_bars(none, 100).count() == 0 and B.time_bars(none, "5m").count() == 0


def test_prefix_over_slices_equals_plain_sum(spark):
    rows = [(at(9 + i // 200, (i * 7 % 200) * 3 // 10, i % 60), "T", "A", 1 + i % 9, 21000 + i % 5) for i in range(600)]
    t = ticks(spark, rows)
    got = B.volume_bars(t, 37).agg(F.sum("volume"), F.sum("trade_count")).first()
    assert tuple(got) == (sum(r[3] for r in rows), 600)


@pytest.mark.parametrize("prints, want", [
    ([(21000, 10, "A")], dict(max_level_volume=10, volume_at_high=10, volume_at_low=10, unfinished_high=0, zero_print_count=0)),
    ([(21001, 10, "A"), (21001, 5, "B"), (21000, 8, "B")], dict(unfinished_high=1, unfinished_low=0)),
    ([(21000, 10, "A"), (21001, 5, "B")], dict(zero_print_count=3, zero_print_ratio=0.6)),
    ([(21000, 10, "A"), (21000, 5, "B"), (21000.25, 20, "A"), (21000.25, 3, "B")], dict(max_level_volume=23, volume_at_high=23, volume_at_low=15)),
    ([(21000 + i / 4, 10, "A") for i in (1, 2, 3)] + [(21000 + i / 4, 1, "B") for i in range(4)],
     dict(stacked_imbalance_count=1, stacked_imbalance_direction=1)),
    ([(21000 + i / 4, 10, s) for i in range(3) for s in "AB"], dict(stacked_imbalance_count=0)),
])
def test_footprint(spark, prints, want):
    bar = B.time_bars(ticks(spark, [(at(10, 0, i), "T", s, n, p) for i, (p, n, s) in enumerate(prints)]), "5m").first()
    assert {k: bar[k] for k in want} == want


def test_session_filters(spark):
    t = ticks(spark, [(at(h, m), "T", "A", 1, 21000) for h, m in ((13, 29), (13, 30), (19, 59), (20, 0), (20, 1))])
    assert sorted(r.seq for r in T.filter_session(t, "rth").collect()) == [1, 2]
    hours = ticks(spark, [(datetime(2025, 2, 3, h), "T", "A", 1, 21000) for h in range(24)])
    assert sorted(r.seq for r in T.filter_session(hours, "eth").collect()) == list(range(8, 21))
    with pytest.raises(ValueError):
        T.filter_session(t, "night")


def test_access_mode():
    a = T.AccessMode()
    assert a.check("train")
    with pytest.raises(RuntimeError):
        a.check("test")
    with pytest.raises(ValueError):
        a.check("nope")
    a.set("research")
    with pytest.raises(PermissionError):
        a.check("test")
    with pytest.raises(RuntimeError):
        a.set("promotion")


def test_bar_configs():
    assert B.parse_bar_config("eth_time_5m") == {"kind": "time", "value": "5m", "seconds": 300, "session": "eth"}
    assert B.parse_bar_config("vol_2000")["value"] == B.parse_bar_config("volume_2000")["value"] == 2000
    assert B.bar_config_label("tick", 610) == "tick_610"
    for bad in ("tick_0", "vol_x", "range_5", "time_0m"):
        with pytest.raises(ValueError):
            B.parse_bar_config(bad)
