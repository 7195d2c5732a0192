"""Tables that grow with the data don't go through the driver to be broadcast, however small their files are."""

import pytest

from roadspark.operators import mapbuild
from roadspark.plans import fixtures
from roadspark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["retag_buildings", "nearest_major_road"])
def test_query_broadcasts_nothing(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


def test_nodes_of_ways_are_not_broadcast(spark):
    assert "Broadcast" not in plan(mapbuild.located(fixtures.ways(spark, SF), fixtures.nodes(spark, SF)))
