"""Forecast models against least squares by numpy, series with known coefficients, and as-of merges against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from costloom.operators import budgets as B

D = dt.date
SHAPE = "scope_id long, date date, cost double"


def day(k):
    return D(2024, 1, 1) + dt.timedelta(days=k)


def made(n, coefficients, noise, seed):
    """A series c + f1 y[-1] + f2 y[-2] + f7 y[-7] with noise."""
    rng = random.Random(seed)
    y = [rng.uniform(20, 60) for _ in range(7)]
    c, f1, f2, f7 = coefficients
    while len(y) < n:
        y.append(c + f1 * y[-1] + f2 * y[-2] + f7 * y[-7] + rng.gauss(0, noise))
    return y


def by_numpy(y):
    """(order, coefficients, deviation) by the corrected Akaike criterion over plain least squares."""
    best = None
    y = np.array(y)
    rows = np.arange(7, len(y))
    for k, order in enumerate(B.ORDERS):
        lags = [lag for lag, used in zip(B.LAGS, order) if used]
        x = np.stack([np.ones(len(rows)), *[y[rows - lag] for lag in lags]], axis=1)
        f, *_ = np.linalg.lstsq(x, y[rows], rcond=None)
        sse = float(((y[rows] - x @ f) ** 2).sum())
        n, p = len(rows), len(lags) + 2
        if n - p - 1 > 0:
            aicc = n * np.log(sse / n) + 2 * p + 2 * p * (p + 1) / (n - p - 1)
            if best is None or aicc < best[0]:
                best = (aicc, order, dict(zip(lags, f[1:])), f[0], np.sqrt(sse / max(1, n - len(lags) - 1)))
    return best


def test_coefficients_and_forecasts_are_those_of_least_squares(spark):
    series = {1: made(120, (12, 0.5, 0.0, 0.3), 0.05, 1), 2: made(60, (5, 0.4, 0.3, 0.0), 1.0, 2), 3: made(16, (30, 0, 0, 0), 3.0, 3), 4: made(90, (3, 0.0, 0.0, 0.9), 0.5, 4), 5: [5.0] * 30, 6: [1.0] + [0.0] * 30, 7: [2.0] * 9}
    rows = [(s, day(k), v) for s, y in series.items() for k, v in enumerate(y)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    got = {r["scope_id"]: r for r in B.fit_autoregression(B.lagged(df, ["scope_id"], 14), ["scope_id"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}  # the last one is too short
    for s in (1, 2, 3, 4):
        _, order, f, c, dev = by_numpy(series[s])
        r = got[s]
        assert (r["p"], r["week"]) == (int(order[0]) + int(order[1]), order[2])
        assert np.allclose([r["c"], r["f1"], r["f2"], r["f7"], r["dev"]], [c, f.get(1, 0), f.get(2, 0), f.get(7, 0), dev], rtol=1e-6, atol=1e-8)
    # known coefficients come back
    assert abs(got[1]["f1"] - 0.5) < 0.05 and abs(got[1]["f7"] - 0.3) < 0.05 and got[1]["week"] and got[4]["week"]
    assert (got[5]["p"], got[5]["week"], got[5]["c"]) == (0, False, 5.0) and got[6]["c"] == 0.0
    end = day(130)
    out = B.forecast(df, ["scope_id"], end, model="ar").collect()
    ahead = {}
    for r in sorted(out, key=lambda r: r["date"]):
        if r["kind"] == "forecast":
            ahead.setdefault(r["scope_id"], []).append(r["yhat"])
    for s in (1, 2, 3, 4, 5):
        y, r = list(series[s]), got[s]
        while len(y) < 130:
            y.append(r["c"] + r["f1"] * y[-1] + r["f2"] * y[-2] + r["f7"] * y[-7])
        assert np.allclose(ahead[s], y[len(series[s]) :], rtol=1e-9)
    assert len([r for r in out if r["kind"] == "fit" and r["scope_id"] == 1]) == 113
    other = B.forecast(df.where("scope_id = 4"), ["scope_id"], end).where("kind = 'forecast'").orderBy("date").collect()
    assert not np.allclose([r["yhat"] for r in other], ahead[4], rtol=1e-3)


def test_models_are_named_or_given(spark):
    df = spark.createDataFrame([(1, day(0), 1.0)], SHAPE)
    with pytest.raises(ValueError):
        B.forecast(df, ["scope_id"], day(9), model="none")
    assert B.forecast(df, ["scope_id"], day(9), model=lambda series, *_: series).count() == 1
    assert B.forecast(df.limit(0), ["scope_id"], day(9), model="ar").count() == 0


def test_all_settings_side_by_side_are_those_one_by_one():
    y = np.array(made(50, (10, 0.2, 0.1, 0.4), 4.0, 9))
    best = None
    for alpha in (0.1, 0.3, 0.6):
        for beta in (0.0, 0.1):
            for gamma in (0.05, 0.3):
                level, trend, cycle, fitted = y[:7].mean(), 0.0, list(y[:7] - y[:7].mean()), []
                for t, value in enumerate(y):
                    s = cycle[t % 7]
                    fitted.append(level + trend + s)
                    e = value - fitted[-1]
                    level, trend, cycle[t % 7] = level + trend + alpha * e, trend + alpha * beta * e, s + gamma * e
                sse = sum((y - fitted) ** 2)
                if best is None or sse < best[0]:
                    best = (sse, fitted, [level + (h + 1) * trend + cycle[(len(y) + h) % 7] for h in range(9)])
    fitted, ahead, dev = B.holt_winters(y, 9)
    assert np.allclose(fitted, best[1]) and np.allclose(ahead, best[2]) and np.isclose(dev, np.sqrt(best[0] / 47))


def test_as_of_is_that_of_brute_force(spark):
    rng = random.Random(4)
    known = [(rng.choice([1, 2, 3, None]), day(rng.randint(0, 40)), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(60)]
    asked = [(rng.choice([1, 2, 4, None]), rng.choice([None, day(rng.randint(0, 45))]), i) for i in range(80)] + [(1, day(20), 7)] * 2
    got = B.asof(spark.createDataFrame(asked, "k int, date date, id int"), spark.createDataFrame(known, "k int, date date, v double"), ["k"], "date", ["v"]).collect()

    def want(k, date):
        if k is None or date is None:
            return None
        days = [d for c, d, _ in known if c == k and d <= date]
        values = [v for c, d, v in known if c == k and days and d == max(days)]
        return max((v for v in values if v is not None), default=None)

    assert sorted((r["id"], str(r["k"]), str(r["date"]), str(r["v"])) for r in got) == sorted((i, str(k), str(d), str(want(k, d))) for k, d, i in asked)


def test_as_of_is_one_sort_without_a_join(spark):
    known = spark.createDataFrame([(1, day(0), 1.0)], "k int, date date, v double")
    plan = B.asof(known.select("k", "date"), known, ["k"], "date", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1


def test_rates_hold_until_the_next_one(spark):
    costs = spark.createDataFrame([("USD", day(3), 10.0), ("USD", day(0), 10.0), ("EUR", day(0), 7.0), ("GBP", day(9), 1.0), (None, day(1), 5.0)], "currency string, charge_date date, billed_cost double")
    rates = spark.createDataFrame([("USD", day(1), 0.5), ("USD", day(3), 0.25), ("USD", day(4), 9.0), ("GBP", day(2), 1.5)], "currency string, date date, rate double")
    got = {(r["currency"], r["charge_date"]): r["cost_eur"] for r in B.in_euro(costs, rates).collect()}
    assert got == {("USD", day(3)): 2.5, ("USD", day(0)): None, ("EUR", day(0)): 7.0, ("GBP", day(9)): 1.5, (None, day(1)): None}


def test_the_legacy_horizon_has_one_day_more(spark):
    df = spark.createDataFrame([(1, day(k), float(k % 7 + 1)) for k in range(28)], SHAPE)
    for model in B.MODELS:
        days = [[r["date"] for r in B.forecast(df, ["scope_id"], day(31), model=model, legacy_horizon=h).where("kind = 'forecast'").orderBy("date").collect()] for h in (False, True)]
        assert days == [[day(28), day(29), day(30)], [day(28), day(29), day(30), day(31)]]
