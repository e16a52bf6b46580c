import random

import numpy as np
import pytest

from cairnlight.operators.ranking import quantile, running_total


@pytest.mark.parametrize("q", [0.0, 0.1, 0.4, 0.5, 0.99, 1.0])
def test_quantile_is_exact(spark, q):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, 2.0]) for _ in range(701)]
    got = quantile(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", q, buckets=16).first()[0]
    assert got == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_quantile_of_little(spark):
    df = spark.createDataFrame([(3.0,)], "v double")
    assert quantile(df, "v", 0.4).first()[0] == 3.0 and quantile(df.limit(0), "v", 0.4).first()[0] is None


def test_running_total_guards_its_columns(spark):
    with pytest.raises(ValueError):
        running_total(spark.range(3), [], "id", ["id"], "_sum")
