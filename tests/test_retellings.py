"""Retellings of a ledger summed in tasks, against the plain statement on another engine."""

import duckdb
import pandas as pd

from tideform.functions import retellings
from tideform.operators import families


def test_nets_equal_the_plain_statement(spark, monkeypatch):
    monkeypatch.setattr(retellings, "SYMBOLS", 2)  # sums are handed on before a third symbol
    rows = [(f"s{k % 5}", k, (-1) ** k * k * 7 + 10**12 * (k % 3)) for k in range(400)]
    con = duckdb.connect()
    con.register("ledger", pd.DataFrame(rows, columns=["symbol", "intent_id", "net_u"]))
    from tideform.plans.sql import dialect

    want = con.execute(dialect(families.MISSED[1], False)).fetchall()
    got = retellings.missed(spark.createDataFrame(rows, "symbol string, intent_id long, net_u long"), families.BLOCKS).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert retellings.missed(spark.createDataFrame([], "symbol string, intent_id long, net_u long"), 3).count() == 0
