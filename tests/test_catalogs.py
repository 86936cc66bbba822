"""Catalogs of variables and interval tables refuse what doesn't fit; order statistics and stopping by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.functions.core import order_statistics, percentiles
from lithic.models.likelihoods import Gaussian, MaximumMargin, Multivariate
from lithic.models.variational import Convergence
from lithic.operators.drillholes import Drillholes, IntervalTable
from lithic.operators.variables import Located


@pytest.fixture(scope="module")
def located(spark):
    rows = spark.createDataFrame([(1, "a", "b", 1.0), (2, "b", "b", 2.0), (3, None, "c", None)], "loc_id long, left string, right string, v double")
    return Located(rows).add_continuous("grade", "v", [2, 1]).add_rock_type("rock", "left", "right").add_categorical("side", "left")


def test_variables(spark, located):
    assert located.variables["rock"].labels == ("a", "b", "c") and located.variables["side"].labels == ("a", "b")
    with pytest.raises(ValueError):
        located.add_continuous("grade", "v")
    with pytest.raises(ValueError):
        located.add_continuous("other", "nowhere")
    with pytest.raises(ValueError):
        located.add_binary("flag", "right", ["a"])
    with pytest.raises(KeyError):
        located.drop("nothing")
    less = located.drop("rock")
    assert less.rows.columns == ["loc_id", "left", "v"] and less.containing("left") == "side" and less.containing("loc_id") is None
    codes = [tuple(r) for r in located.rows.orderBy("loc_id").select(*located.codes("rock"), located.on_contact("rock")).collect()]
    assert codes == [(0, 1, True), (1, 1, False), (-1, 2, True)]
    longer = located.carry_to(spark.createDataFrame([(9,)], "loc_id long"), F.col("v") > 1)
    assert [tuple(r) for r in longer.rows.orderBy("loc_id").collect()] == [(2, "b", "b", 2.0), (9, None, None, None)]
    assert located.set_responsibilities("grade", "r").variables["grade"].responsibilities == "r"
    assert located.set_cutoffs("grade", [3, 1]).variables["grade"].cutoffs == (1.0, 3.0)
    coded = located.add_metadata("code", "left", ["b"])
    assert [r.t for r in coded.rows.orderBy("loc_id").select(coded.metadata("code").alias("t")).collect()] == [None, "b", None]


def test_interval_tables(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0, 0.5, "x"), (1, 2.0, 3.0, 0.7, "y"), (7, 0.0, 1.0, 0.1, "x")], "hole long, f double, t double, zn double, rock string")
    holes = Drillholes(spark.createDataFrame([(1, 10.0)], "hole long, length double"))
    more, found = holes.add_intervals("assay", rows, {"zn": "grade"})
    assert {r.issue for r in found.collect()} == {"hole is not in the collar table"}
    with pytest.raises(ValueError):
        holes.add_intervals("assay", rows, on_error="raise")
    with pytest.raises(ValueError):
        more.add_intervals("assay", rows)
    table = more["assay"].set_role("rock", "categorical").rename({"zn": "rock", "rock": "zn"})
    assert table.rows.columns == ["hole", "f", "t", "rock", "zn"] and table.with_role("grade") == ["rock"] and table.with_role("categorical") == ["zn"]
    for names in ({"zn": "rock"}, {"hole": "x"}, {"zn": "f"}, {"none": "x"}):
        with pytest.raises(ValueError):
            more["assay"].rename(names)
    with pytest.raises(ValueError):
        IntervalTable(rows, {"zn": "nothing"})
    two, _ = more.add_intervals("second", rows, on_error="ignore")
    assert list(two.rename_table("assay", "first").tables) == ["first", "second"] and list(two.drop_table("assay").tables) == ["second"]
    with pytest.raises(ValueError):
        two.rename_table("assay", "second")
    with pytest.raises(KeyError):
        two.drop_table("third")


def test_order_statistics(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal(400), [5.0] * 60, [1e300, -1e-300, 1e-300]])
    df = spark.createDataFrame([(float(x),) for x in [*v, float("nan")]] + [(None,)], "v double")
    s = np.sort(v)
    assert order_statistics(df, "v", [1, 17, 300, 430, 463, 464], bins=7) == {r: s[r - 1] for r in (1, 17, 300, 430, 463)}
    assert np.allclose(percentiles(df, "v", [0.0, 0.1, 0.5, 0.77]), np.quantile(v, [0.0, 0.1, 0.5, 0.77]))
    assert percentiles(df.limit(0), "v", [0.5]) == [None]


def test_stopping():
    rule, values = Convergence(0.05, 4), [100 * (1 - np.exp(-k / 3)) for k in range(60)]
    smooth, hits = [], []
    for v in values:
        smooth.append(v if not smooth else 0.4 * v + 0.6 * smooth[-1])
        hits.append(len(smooth) > 4 and abs(smooth[-1] - smooth[-5]) < 0.05 * abs(smooth[-1] - values[0]))
    assert [rule.stop(v) for v in values] == hits and any(hits) and not any(Convergence(0).stop(v) for v in values)


def test_several_variables_add_up():
    rng = np.random.default_rng(2)
    y, m, v = rng.standard_normal((6, 2)) + 3, rng.standard_normal((6, 2)), rng.uniform(0.1, 1, (6, 2))
    two = Multivariate(Gaussian(0.3), 2).initialize(y)
    value, by_mean, by_var = two.expectations(y, m, v)
    z = (y - y.mean(0)) / y.std(0)
    want = (-0.5 * np.log(2 * np.pi * 0.3) - ((z - m) ** 2 + v) / 0.6).sum(1) - np.log(y.std(0)).sum()
    assert np.allclose(value, want) and np.allclose(by_mean, (z - m) / 0.3) and np.allclose(by_var, -1 / 0.6)
    assert np.allclose(two.predictive_mean(z, v), y)
    f = np.array([0.5, -0.5, 2.0])
    assert np.allclose(np.exp(MaximumMargin(2.0).log_density(np.ones(3), f)), 1 / (1 + np.exp(-2 * np.array([1.0, -1.0, 3.0]))))
    assert np.allclose(MaximumMargin(2.0).predictive_mean(np.array([0.0]), np.array([1.0])), 0.5)
