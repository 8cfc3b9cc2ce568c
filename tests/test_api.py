import pytest
from pyspark.sql import functions as F

from stowage.plans import bindings as B
from stowage.plans.api import Network, NotFound
from stowage.sources import synth
from stowage.plans import dims


@pytest.fixture(scope="module")
def net(spark, sf_dir):
    return Network(spark, B.positions(spark, sf_dir), synth.fleet(dims.stations(spark), 500), B.as_of())


def test_stations(net):
    assert net.stations().count() == 8 and net.hubs().count() == 4 and net.connections("atl").count() == 7 and net.connections("JFK").count() == 4
    with pytest.raises(NotFound):
        net.station("XXX")


def test_tracking(spark, net):
    assert net.position(7).count() == 1 and net.movements(7, 90).count() > 0 and net.summary().count() == 8 and net.inventory("ATL").count() == 1
    with pytest.raises(NotFound):
        net.position(-1)
    with pytest.raises(ValueError):
        net.movements(7, 91)
    rows = spark.createDataFrame([("AKE00001XX", "AKE", "ATL"), ("AKE00002XX", "AKE", "bad")], "uld_id string, uld_type string, station string")
    assert net.ping(rows).first()["confidence"] == 0.95 and net.ping(rows).count() == 1
    with pytest.raises(ValueError):
        net.ping(rows.withColumn("uld_type", F.lit("ZZZ")))


def test_forecasts_and_recommendations(net):
    assert net.demand(6).count() == 48 and net.supply(6).count() == 48 and net.imbalance(6).count() == 48
    assert net.network(6).first()["stations"] == 8 and net.priority(6, 3).count() == 3
    assert net.repositioning().filter("origin = destination OR quantity <= 0").isEmpty()
    assert net.plan().count() >= 0 and net.recommendation_summary().count() == 1 and net.optimize().filter("quantity > 20").isEmpty()
    with pytest.raises(ValueError):
        net.optimize(max_moves=21)
