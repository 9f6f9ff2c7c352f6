import math

import numpy as np

from ringdata.operators import learn as M


def brute(s, y):
    """Plain gradient descent on the smoothed targets, to convergence."""
    pos, neg = sum(y), len(y) - sum(y)
    s, t = np.array(s), np.where(np.array(y) == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = b = 0.0
    for _ in range(200_000):
        g = t - 1 / (1 + np.exp(-(a * s + b)))
        a, b = a + (g * s).mean(), b + g.mean()
    return a, b


def test_fit_against_gradient_descent(spark):
    r = np.random.default_rng(5)
    s = r.random(400).round(3).tolist()
    y = [int(r.random() < 1 / (1 + math.exp(-(6 * x - 2)))) for x in s]
    df = spark.createDataFrame(list(zip(s, y)) + [(None, 1), (0.5, None)], "p double, label int")
    assert np.allclose(M.platt_fit(df), brute(s, y), atol=1e-5)


def test_odd_inputs(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, p double, label int")
    assert M.platt_fit(frame([])) == (0.0, 0.0)
    slope, intercept = M.platt_fit(frame([(i, 0.3, int(i % 4 == 0)) for i in range(8)]))
    assert slope == 0.0 and 0 < 1 / (1 + math.exp(-intercept)) < 0.5
    apart = [(i, float(i >= 50) * 1000 + i, int(i >= 50)) for i in range(100)]
    a, b = M.platt_fit(frame(apart))
    assert math.isfinite(a) and math.isfinite(b) and a > 0
    got = M.platt_cross_calibrate(frame([*apart, (100, None, 1)]), "id").collect()
    assert sorted(r.id for r in got) == list(range(101)) and [r.calibrated for r in got if r.id == 100] == [None]
