"""Candidate sessions against a machine that looks at each record."""

import random

import numpy as np
import pytest

from tideform import queries
from tideform.functions import machines

DATA = "/root/testdata/sf0.001"


def plain(seq, ms, bid, ask, signals, side, rules):
    """Record by record: protective orders, the close, a waiting order, then a new signal."""
    out, trade, waiting, entries, last_bar = [], None, None, 0, None
    for k, (q, t, b, a) in enumerate(zip(seq, ms, bid, ask)):
        bar, live = t // rules.bar_ms, a > b
        if trade and live:
            price = b if side == 1 else a
            gain = side * (price - trade["entry"])
            trade["last"] = (q, price)
            trade["mae"], trade["mfe"] = min(trade["mae"], gain), max(trade["mfe"], gain)
            if gain <= trade["stop"] or gain >= rules.target_u:
                out.append((trade["signal"], trade["seq"], trade["entry"], q, price, "STOP" if gain <= trade["stop"] else "TARGET", trade["mae"], trade["mfe"]))
                trade = None
            else:
                trade["best"] = max(trade["best"], gain)
                if rules.even_ppm and gain > 0 and gain * 10**6 >= rules.target_u * rules.even_ppm:
                    trade["stop"] = max(trade["stop"], rules.even_u)
                if rules.trail_u:
                    trade["stop"] = max(trade["stop"], trade["best"] - rules.trail_u)
        if k == len(seq) - 1:
            if trade:
                end = trade["last"]
                out.append((trade["signal"], trade["seq"], trade["entry"], *(end or (None, None)), "CLOSE" if end else "UNRESOLVED", trade["mae"], trade["mfe"]))
            return out
        if waiting:
            waiting[1] += 1
            if waiting[1] > rules.expiry:
                waiting = None
            elif not trade and live and entries < rules.per_day and bar != last_bar:
                entry = a + rules.slip_u if side == 1 else b - rules.slip_u
                trade = {"signal": waiting[0], "seq": q, "entry": entry, "stop": -rules.stop_u, "best": 0, "mae": 0, "mfe": 0, "last": None}
                waiting, entries, last_bar = None, entries + 1, bar
        if q in signals and not trade and not waiting and entries < rules.per_day and bar != last_bar:
            waiting = [q, 0]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_session(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        n = rnd.randint(1, 120)
        bid = (1000 + np.cumsum([rnd.randint(-6, 6) for _ in range(n)])).astype(np.int64)
        ask = bid + np.array([rnd.choice([0, 1, 2, -1]) for _ in range(n)])
        ms = np.cumsum([rnd.choice([0, 1, 400]) for _ in range(n)]) + 10_000
        seq = np.arange(5, 5 + n)
        signals = np.array(sorted(rnd.sample(range(5, 5 + n), rnd.randint(0, n // 4))), np.int64)
        rules = machines.Rules(rnd.choice([1, 3, 50]), rnd.choice([1, 3, 5]), rnd.choice([5, 15, 40]), rnd.choice([8, 30]), rnd.choice([0, 300_000, 900_000]), rnd.choice([0, 2, 6]), rnd.choice([0, 4, 12]), rnd.choice([0, 1]), rnd.choice([500, 5000]))
        for side in (1, -1):
            got = machines.session(seq, ms, bid, ask, signals, side, rules)
            want = plain(seq.tolist(), ms.tolist(), bid.tolist(), ask.tolist(), set(signals.tolist()), side, rules)
            assert got == want, (rules, side)


def test_registered(spark):
    got = queries.queries()["candidate_machine"](spark, DATA)
    rows = got.collect()
    assert rows and {r.reason for r in rows} <= {"STOP", "TARGET", "CLOSE", "UNRESOLVED"} and max(map(lambda r: r.entry_seq - r.signal_seq, rows)) <= 50
    assert got.where("exit_seq <= entry_seq or entry_seq <= signal_seq").count() == 0
    none = machines.trades(queries.PLANS["tick_view"].run(spark, DATA).where("false"), queries.RAISED.run(spark, DATA))
    assert none.count() == 0
