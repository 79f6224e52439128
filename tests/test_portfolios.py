"""Allocation over day ends, settlement and session schedules against plain loops."""

import random

import pytest

from tideform.functions import portfolios

DAY = 86_400_000_000_000
OFFERS = "symbol string, session_day long, entry_ts_ns long, exit_ts_ns long, priority int, offer_id long, bar_ms long, net_u long, usd_micro_per_unit long"


def offers(seed, n, longest):
    rnd, rows = random.Random(seed), []
    for k in range(n):
        entry = rnd.randrange(0, 30 * DAY, 600_000_000_000)
        rows.append((rnd.choice("ABC"), entry // DAY, entry, entry + 1 + rnd.randrange(0, longest), rnd.randrange(3), k, rnd.choice([3_600_000, 14_400_000]), rnd.randint(-500, 500), 1000 if k % 2 else 1500))
    return rows


def plain(rows, per_symbol, per_day, capital):
    busy, last, own, every, out, cash = {}, {}, {}, {}, {}, {}
    for s, day, entry, end, _, k, bar, net, money in sorted(rows, key=lambda r: (r[2], r[4], r[5])):
        if s in busy and entry <= busy[s]:
            out[k] = "OVERLAP"
        elif s in last and last[s] // (bar * 1_000_000) == entry // (bar * 1_000_000):
            out[k] = "SAME_BAR"
        elif own.get((s, day), 0) >= per_symbol or every.get(day, 0) >= per_day:
            out[k] = "DAILY_LIMIT"
        else:
            out[k] = ""
            busy[s], last[s] = end, entry
            own[s, day], every[day] = own.get((s, day), 0) + 1, every.get(day, 0) + 1
            cash[end] = cash.get(end, 0) + net * money
    equity = peak = capital
    fall = 0
    for t in sorted(cash):
        equity += cash[t]
        peak = max(peak, equity)
        fall = max(fall, peak - equity)
    return out, equity, fall


@pytest.mark.parametrize("seed,n,longest", [(1, 400, DAY // 20), (2, 400, 2 * DAY), (3, 150, 20 * DAY), (4, 60, DAY // 3)])
def test_allocation_across_day_ends(spark, seed, n, longest):
    rows = offers(seed, n, longest)
    df = spark.createDataFrame(rows, OFFERS).repartition(4)
    want, equity, fall = plain(rows, 2, 4, 10**9)
    got = portfolios.allocate(df, 2, 4)
    assert {r.offer_id: r.reason for r in got.collect()} == want
    r = portfolios.settle(got, 10**9).first()
    assert (r.offered, r.final_micro, r.drawdown_micro) == (n, equity, fall)
    assert (r.accepted, r.overlap, r.same_bar, r.daily_limit) == tuple(list(want.values()).count(x) for x in ("", "OVERLAP", "SAME_BAR", "DAILY_LIMIT"))
    if longest < DAY:
        assert portfolios.segments(df).select("segment").distinct().count() > 1


def test_no_offers(spark):
    none = spark.createDataFrame([], OFFERS)
    assert portfolios.allocate(none).count() == 0
    assert tuple(portfolios.settle(portfolios.allocate(none), 5).first()) == (0, 0, 0, 0, 0, 5, 0)


def test_schedule(spark):
    rows = [(s, 1, k, *x) for s in "ab" for k, x in enumerate([
        (10, 20, True, "", 1.0), (15, 30, True, "", 5.0), (21, 22, False, "", 5.0), (23, None, True, "NO_ENTRY", None), (24, None, True, "GEOMETRY", None), (25, None, True, "UNRESOLVED", None),
        (26, 27, True, "", -2.0), (27, 28, True, "", 9.0), (28, 29, True, "", 0.5), (30, 31, True, "", 7.0),
    ])]
    df = spark.createDataFrame(rows, "symbol string, session_day long, intent_id long, signal_seq long, exit_seq long, inside boolean, state string, r double")
    got = {r.intent_id: r.reason for r in portfolios.schedule(df).where("symbol = 'a'").collect()}
    assert got == {0: "", 1: "PAST", 2: "SESSION", 3: "NO_ENTRY", 4: "GEOMETRY", 5: "UNRESOLVED", 6: "", 7: "PAST", 8: "", 9: "CAP"}
    r = portfolios.schedule_report(portfolios.schedule(df)).where("symbol = 'b'").first()
    assert (r.signals, r.trades, r.past, r.cap, r.total_r, r.gains_r, r.losses_r, r.drawdown_r) == (10, 3, 2, 1, -0.5, 1.5, 2.0, 2.0)
