"""Every domain, however rare, ends at its own target; targets out of reach are reported."""

import numpy as np
import pytest

from bitloom.llm import mixing


def grouped(spark, q, w):
    return spark.createDataFrame([(row.tolist(), int(n)) for row, n in zip(q, w, strict=True)], "__p array<long>, __w long").repartition(3)


@pytest.mark.parametrize("share", [(0.616, 0.149, 0.131, 0.104), (0.8, 0.15, 0.04, 0.01), (0.95, 0.03, 0.015, 0.005)])
def test_skewed_domains_meet_their_targets(spark, share):
    q, w = np.eye(4, dtype=int) * mixing.UNIT, np.round(1e9 * np.array(share))
    want = share / np.sum(share)
    want = want**0.7 / (want**0.7).sum()
    targets = want * (w / want).max()
    r = mixing.rates(q, mixing.solve(grouped(spark, q, w), 4))
    assert np.abs(w * r / targets - 1).max() < 1e-3
    assert (np.diff(r) > 0).all()  # the rarer, the higher


def test_soft_posteriors_with_rates_at_zero(spark):
    rng = np.random.default_rng(1)
    q, w = mixing.whole_posterior(3 * rng.normal(size=(300, 5)) + np.log([0.9, 0.06, 0.02, 0.01, 0.01])), rng.integers(1, 3000, 300)
    targets = (w * np.where(q.argmax(1) == 0, 0.0, 4.0)) @ (q / mixing.UNIT)
    r = mixing.rates(q, mixing.solve(grouped(spark, q, w), 5, targets=targets))
    assert (r >= 0).all() and (r == 0).any() and np.abs((w * r) @ (q / mixing.UNIT) / targets - 1).max() < 1e-3


def test_targets_out_of_reach_are_reported(spark):
    q, w = np.array([[7000, 3000], [6000, 4000]]), np.array([100, 100])
    with pytest.warns(RuntimeWarning, match="targets are not met"):
        mixing.solve(grouped(spark, q, w), 2, targets=np.array([50.0, 150.0]))
