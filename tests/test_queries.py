import pytest

import __spark_entry__ as entry
from oracle import compare

SF = "/root/testdata/sf0.001"
Q, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(n for n, fn in Q.items() if not fn.__wrapped__.__module__.startswith("contactweave.llm"))


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_equals_sql(spark, name):
    assert compare(spark, Q[name], SQL[name], SF) == ""


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_runs(spark, name):
    df = Q[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["line_id", "reason"]
