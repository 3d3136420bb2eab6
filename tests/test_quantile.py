"""The distributed exact quantile equals numpy's linear interpolation."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from receivables.functions import quantile
from receivables.functions.quantile import exact_quantile


@settings(max_examples=15, deadline=None)
@given(
    vals=st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False).map(lambda x: round(x, 2)), min_size=1, max_size=60),
    q=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]),
)
def test_matches_numpy(spark, vals, q):
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = exact_quantile(df, "x", q).first()[0]
    exp = float(np.quantile(vals, q))
    assert abs(got - exp) <= 1e-9 * max(1.0, abs(exp))


def test_heavy_duplicates_and_empty(spark):
    vals = [7.0] * 50 + [0.0] * 3 + [-1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_quantile(df, "x", 0.95).first()[0] == float(np.quantile(vals, 0.95))
    assert exact_quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5).first()[0] is None


def test_unrounded_doubles_crowded_into_one_bucket(spark):
    """All values within one bucket: its cells divide them, and no task ranks more than a small part."""
    rng = np.random.default_rng(2)
    v = 1000.0 + rng.random(4000) * 0.5
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert df.select(quantile._bucket(F.col("v"))).distinct().count() <= 2
    per_cell = df.groupBy(quantile._bucket(F.col("v"), quantile._CELLS)).count().agg(F.max("count")).first()[0]
    assert per_cell < 40
    for q in (0.0, 0.1, 0.5, 0.95, 1.0):
        assert quantile.exact_quantile(df, "v", q).first()[0] == pytest.approx(np.quantile(v, q), abs=1e-12)
