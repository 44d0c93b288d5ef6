"""Every query of the catalogue with SQL against DuckDB, at the smallest scale."""

import duckdb
import pytest

from streamloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    plain = lambda v: None if v is None or v != v else v.isoformat() if hasattr(v, "isoformat") else v
    return sorted(str(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(catalogue.ORACLE_SQL[name]).df())


def test_cells_on_way_start_and_end_where_the_ride_does(spark):
    from pyspark.sql import functions as F

    from streamloom.functions import geo
    from streamloom.operators.trips import cleanse
    from streamloom.plans.adapter import rides

    own = cleanse(rides(spark, DATA))
    ends = own.select(geo.grid_cell("start_lon", "start_lat").alias("a"), geo.grid_cell("end_lon", "end_lat").alias("b"), geo.cells_on_way("start_lon", "start_lat", "end_lon", "end_lat").alias("c"))
    assert ends.where("not (c[0] = a and element_at(c, -1) = b or c[0] = b and element_at(c, -1) = a)").count() == 0
    steps = ends.select(F.explode(F.expr("filter(transform(c, (x, i) -> abs(x - c[greatest(i - 1, 0)])), (d, i) -> i > 0)")).alias("d"))
    assert {r.d for r in steps.distinct().collect()} <= {1, 249, 250, 251}


def test_cells_on_a_long_way_have_no_gap(spark):
    from pyspark.sql import functions as F

    from streamloom.functions import geo

    row = spark.range(1).select(geo.cells_on_way(F.lit(-74.05), F.lit(40.9), F.lit(-60.0), F.lit(40.9)).alias("c")).first()
    assert len(row.c) > 10_000 and all(b == a + 1 for a, b in zip(row.c, row.c[1:]))
