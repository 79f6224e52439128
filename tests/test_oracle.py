"""Every query with SQL against the same SQL on another engine: names, kinds of types, rows and values."""

import duckdb
import pandas as pd
import pytest

from tideform import queries
from tideform.plans.sql import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def kind(t: str) -> str:
    t = t.lower()
    return "int" if "int" in t else "float" if "double" in t or "float" in t else "decimal" if "decimal" in t else "bool" if "bool" in t else "text"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches(spark, duck, name):
    mine = queries.queries()[name](spark, DATA)
    sql = queries.oracle_sql()[name]
    theirs = duck.execute(sql)
    types = {d[0]: str(d[1]) for d in theirs.description}
    assert "HUGEINT" not in types.values(), types
    assert {c: kind(t) for c, t in mine.dtypes} == {c: kind(t) for c, t in types.items()}
    b, a = theirs.df(), mine.toPandas()
    cols = sorted(a.columns)
    as_rows = lambda f: sorted(tuple("" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "is_integer") else str(v) for v in r) for r in f[cols].itertuples(index=False))
    number = lambda v: None if pd.isna(v) else float(v)
    clean = lambda f: f.assign(**{c: f[c].map(number).astype("float64") for c in cols if kind(types[c]) != "text"})
    assert as_rows(clean(a)) == as_rows(clean(b))


def test_partitions_do_not_matter(spark):
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, queries.queries()["replay_intents"](spark, DATA).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]
