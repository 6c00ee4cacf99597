"""Means and what is compared with them must not depend on the order in which scenes come."""

import datetime as dt

import duckdb
import pytest

from fluxloom import plans
from fluxloom.operators import stack as S

DAY = dt.datetime(1995, 1, 1)
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp"
ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp"
#: Scenes (quantity, line number) of one day, whose (1 + lswi) / 2 has a mean of just 0.7659375.
HALF = [(5.0, 1), (20.0, 3), (29.0, 1), (50.0, 5)]


def tables(spark, folder, scenes):
    """One pixel with two green days around the day of the scenes, and weather on the three days."""
    low = [(1, 1, 0, ln, q, 0.1, 0.0, DAY + dt.timedelta(1)) for q, ln in scenes]
    high = [(1, 1, 0, ln, 50.0, 0.0, 0.0, DAY + dt.timedelta(d)) for d, ln in ((0, 1), (2, 7))]
    spark.createDataFrame(low + high, LINES).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, 1, 1000.0 + k, DAY + dt.timedelta(k % 3)) for k in range(9)], ORDERS).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def both(spark, name, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = plans.QUERIES[name](spark, folder), con.execute(plans.ORACLE_SQL[name]).df()
    return (sorted(map(tuple, f.astype(object).where(f.notna(), None)[sorted(f.columns)].itertuples(index=False))) for f in (got.toPandas(), want))


@pytest.mark.parametrize("values", [(0.1, 0.2, 0.3), (1e5, 0.1, 0.7), (3e12, 0.1, -3e12)])
def test_mean_of_a_day_is_the_same_in_any_order(spark, values):
    rows = [(1, 1, DAY, v) for v in values]
    day = lambda r: S.merge_same_day(spark.createDataFrame(r, "x int, y int, scene_ts timestamp, evi double").coalesce(1), ["evi"]).first()["evi"]
    if max(values) < 1e6:
        assert day(rows) == day(rows[::-1])
    assert day(rows) == pytest.approx(sum(values) / 3, abs=1e-3)


@pytest.mark.parametrize("name", ["v01_v03_without_xeric", "v01_v07_j13_features", "v07_features_on_grid"])
def test_halves_do_not_depend_on_the_order_of_scenes(spark, tmp_path, name):
    """All orders of the scenes give what the SQL gives, to the last bit."""
    results = [r for k, s in enumerate((HALF, HALF[::-1], HALF[1:] + HALF[:1], HALF[2:] + HALF[:2], [HALF[i] for i in (1, 3, 0, 2)])) for r in both(spark, name, tables(spark, tmp_path / str(k), s))]
    assert len(results[0]) == 18
    assert all(r == results[0] for r in results)
