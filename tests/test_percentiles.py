"""Percentiles equal Spark's exact ones, which gather all values in one task."""

import random

import pytest
from pyspark.sql import functions as F

from ranksmith.operators import aggregations

PERCENTS = (0, 1, 50, 99, 100)
_R = random.Random(1)


@pytest.mark.parametrize("values", [[_R.gauss(0, 1) for _ in range(3000)] + [None], [_R.random() for _ in range(500)] + [1e300, -1e300], [1.0, 2.0, 2.0, 7.0], [None]])
def test_percentiles(spark, values):
    rows = spark.createDataFrame([(x,) for x in values], "v double")
    want = list(rows.agg(*[F.percentile("v", F.lit(p / 100.0)) for p in PERCENTS]).collect()[0])
    out = aggregations.percentiles(rows, "v", PERCENTS)
    assert [v for _, v in sorted(map(tuple, out.collect()))] == want
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
