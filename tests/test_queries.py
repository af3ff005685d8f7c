"""Every query with SQL gives the SQL's rows; the others run."""

import pytest
from conftest import SMALL, canon

import __spark_entry__ as entry
from strandlake.operators import table as O
from strandlake.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    if name not in SQL:
        assert got.count() > 0
        return
    want = duck.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    order = [d[0] for d in want.description]
    rows = [[r[order.index(c)] for c in columns] for r in want.fetchall()]
    assert canon([r[c] for c in columns] for r in got.collect()) == canon(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_evolution_errors(spark):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "a int, b double")
    assert [r.b for r in O.change_type(df, "b", "int").collect()] == [2, 4]
    with pytest.raises(ValueError):
        O.remove_column(df, "x")
    with pytest.raises(ValueError):
        O.reorder_columns(df, ["a", "x"])
    with pytest.raises(ValueError):
        O.add_column(df, "a", df.a)
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        O.change_type(spark.createDataFrame([(1e12,)], "b double"), "b", "int").collect()
