"""Every registered catalogue query against its oracle at the smallest scale, and the plans that matter."""

import pytest
from conftest import SF
from oracles import same

from skylattice.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_file_inventory_is_in_order_of_size(spark):
    rows = registry.QUERIES["file_inventory"](spark, SF).collect()
    assert len(rows) > 1 and [r.length for r in rows] == sorted(r.length for r in rows)


def test_cells_bear_no_whole_cube(spark):
    text = plan(registry.QUERIES["cube_flatten"](spark, SF))
    assert "Generate inline" in text and "posexplode" not in text


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_spatial_join_is_no_nested_loop(spark):
    text = plan(registry.QUERIES["search_counts"](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(registry.QUERIES["catalog_search"](spark, SF))


def test_dates_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from skylattice.operators.catalog import open_window

    text = plan(spark.read.parquet(f"{SF}/orders.parquet").where(open_window(F.col("o_orderdate"), "1997-01-01", "1997-02-01")))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in text
