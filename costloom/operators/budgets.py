"""Budgets as of a month, forecasts of many scopes at once, anomalies and forecast quality."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from costloom.functions.tables import durable


def asof(wanted: DataFrame, known: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Rows of ``wanted`` (keys, time, others) with the latest ``values`` of ``known`` at or before their time.

    Both sides are merged by one sort a key, and the last known value is carried forward; no row of one
    side meets a row of the other. Rows before the first known value, and rows with a null key or time, have null values. Of several
    known rows of one key and time the largest values count; a null value is a value like others.
    """
    rest = [c for c in wanted.columns if c not in (*keys, time)]
    known = known.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("__value"))
    kind = known.schema["__value"].dataType
    left = wanted.select(*keys, time, F.struct(F.lit(1).alias("__one"), *rest).alias("__row"), F.lit(None).cast(kind).alias("__value"), F.lit(1).alias("__side"))
    none = F.lit(None).cast(left.schema["__row"].dataType)
    right = known.select(*keys, time, none.alias("__row"), "__value", F.lit(0).alias("__side"))
    before = W.partitionBy(*keys).orderBy(time, "__side").rowsBetween(W.unboundedPreceding, 0)
    merged = left.unionByName(right).withColumn("__last", F.last("__value", ignorenulls=True).over(before)).where("__side = 1")
    usable = F.col(time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return merged.select(*keys, time, *[F.col(f"__row.{c}").alias(c) for c in rest], *[F.when(usable, F.col(f"__last.{c}")).alias(c) for c in values])


def budget_asof(budgets: DataFrame, scopes: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """The latest limit at or before each scope's month: (keys, month, limit_amount); scopes without one are left out."""
    return asof(scopes.select(*keys, month), budgets, keys, month, ["limit_amount"]).where("limit_amount IS NOT NULL")


def in_euro(costs: DataFrame, rates: DataFrame, date: str = "charge_date", cost: str = "billed_cost") -> DataFrame:
    """``costs`` (currency, date, cost, others) with ``rate`` and ``cost_eur``, by the newest rate at or before the day.

    ``rates`` has (currency, date, rate). EUR has the rate 1; a currency without a rate on the day has null in
    both columns. Currencies are few and costs many, so only the distinct (currency, day) pairs are merged with the rates.
    """
    days = costs.where("currency <> 'EUR'").select("currency", date).distinct()
    known = asof(days, rates.withColumnRenamed("date", date) if date != "date" else rates, ["currency"], date, ["rate"])
    rows = costs.join(known, ["currency", date], "left").withColumn("rate", F.when(F.col("currency") == "EUR", 1.0).otherwise(F.col("rate")))
    return rows.withColumn("cost_eur", F.col(cost) * F.col("rate"))


def budget_active_scopes(budgets: DataFrame, month: dt.date, keys: list[str]) -> DataFrame:
    """Scopes with any budget at or before a month."""
    return budgets.where(F.col("month") <= F.lit(month)).select(*keys).distinct()


def cutoff_date(max_dates: DataFrame, as_of: dt.date) -> DataFrame:
    """The last day with confirmed costs: the latest charge date, but no later than yesterday."""
    return max_dates.select("*", F.least("max_date", F.date_sub(F.lit(as_of), 1)).alias("cutoff"))


def series_prepare(daily: DataFrame, keys: list[str], cutoff: dt.date) -> DataFrame:
    """Gap-free daily series from each scope's first day with a positive cost up to the cutoff."""
    first = daily.where("cost > 0").groupBy(*keys).agg(F.min("date").alias("__first"))
    return daily.where(F.col("date") <= F.lit(cutoff)).join(first, keys).where("date >= __first").select(*keys, "date", "cost")


def forecast_sma(series: DataFrame, keys: list[str], horizon: int, last: int = 7) -> DataFrame:
    """(keys, date, predicted): the mean of the last observations on each of the next ``horizon`` days."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date")))
    mean = series.withColumn("__p", place).where(F.col("__p") <= last).groupBy(*keys).agg(F.avg("cost").alias("predicted"), F.max("date").alias("__end"))
    return mean.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.date_add(F.col("__end"), k))).alias("date"), "predicted")


#: Settings of the smoothing model: weights of level, trend and season (fixed values).
GRID = np.array([(alpha, beta, gamma) for alpha in (0.1, 0.3, 0.6) for beta in (0.0, 0.1) for gamma in (0.05, 0.3)]).T


def holt_winters(y: np.ndarray, horizon: int, season: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Fitted values, forecast and residual deviation of additive smoothing with a weekly season.

    The setting is the first of :data:`GRID` with the least squared one-step errors; all run side by side.
    """
    alpha, beta, gamma = GRID
    level, trend = np.full(len(alpha), y[:season].mean()), np.zeros(len(alpha))
    cycle = y[:season, None] - level
    fitted = np.empty((len(y), len(alpha)))
    for t, value in enumerate(y):
        s = cycle[t % season]
        fitted[t] = level + trend + s
        error = value - fitted[t]
        level, trend = level + trend + alpha * error, trend + alpha * beta * error
        cycle[t % season] = s + gamma * error
    sse = ((y[:, None] - fitted) ** 2).sum(0)
    k = int(sse.argmin())
    ahead = np.array([level[k] + (h + 1) * trend[k] + cycle[(len(y) + h) % season, k] for h in range(horizon)])
    return fitted[:, k], ahead, float(np.sqrt(sse[k] / max(1, len(y) - 3)))


def smoothed(series: DataFrame, keys: list[str], end: dt.date, least: int, z: float) -> DataFrame:
    """The model ``ets``: Holt-Winters with a weekly season, one grouped job over all series."""
    fields = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        if len(pdf) < least:
            return pd.DataFrame(columns=[*keys, "date", "kind", "y", "yhat", "hi"])
        last = pdf["date"].iloc[-1]
        horizon = max(0, (end - last).days - 1)
        fitted, ahead, dev = holt_winters(pdf["cost"].to_numpy(float), horizon)
        days = [*pdf["date"], *(last + dt.timedelta(days=h + 1) for h in range(horizon))]
        yhat = np.concatenate([fitted, ahead])
        out = pd.DataFrame({"date": days, "kind": ["fit"] * len(pdf) + ["forecast"] * horizon, "y": [*pdf["cost"], *[None] * horizon], "yhat": yhat, "hi": yhat + z * dev})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "date", "kind", "y", "yhat", "hi"]]

    shape = ", ".join([*(f"{k} {fields[k]}" for k in keys), "date date, kind string, y double, yhat double, hi double"])
    return series.groupBy(*keys).applyInPandas(run, shape)


#: Lags of the autoregressive model, and its orders as the lags that count: p of 0 to 2 days, P of 0 or 1 week.
LAGS = (1, 2, 7)
ORDERS = [(p > 0, p > 1, week) for week in (False, True) for p in (0, 1, 2)]


def lagged(series: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Days (keys, date, y, l1, l2, l7) of series with at least ``least`` days; without each series' first week."""
    w = W.partitionBy(*keys).orderBy("date")
    rows = series.select(*keys, "date", F.col("cost").alias("y"), *[F.lag("cost", n).over(w).alias(f"l{n}") for n in LAGS], F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("__n"))
    return rows.where((F.col("__n") >= least) & F.col("l7").isNotNull()).drop("__n")


def fit_autoregression(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c, f1, f2, f7, p, week, dev): each series' constant and lag coefficients, order and residual deviation.

    Conditional least squares on the days that have all lags, for every order, by sums that combine before
    the shuffle; the order with the least corrected Akaike criterion counts, of equal ones the smaller.
    An order whose lags are collinear, or that has too few days, is left out; a constant is always possible.
    """
    names = [f"l{n}" for n in LAGS]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"),
        *[F.avg(a).alias(f"m_{a}") for a in names], *[F.covar_pop(a, "y").alias(f"b_{a}") for a in names], *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs],
    )
    orders = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(x).alias(a) for a, x in zip(names, order)]) for k, order in enumerate(ORDERS)])
    tried = sums.withColumn("o", F.explode(orders))

    def cell(a: str, b: str) -> Column:
        return F.when(F.col(f"o.{a}") & F.col(f"o.{b}"), F.col(f"{a}_{b}")).otherwise(F.lit(1.0 if a == b else 0.0))

    # triangular elimination of the normal equations; a lag that doesn't count is a unit row
    c = {(a, b): cell(a, b) for a, b in pairs}
    one, two, seven = names
    tried = tried.withColumns({"d1": c[one, one], "e12": c[one, two], "e17": c[one, seven], **{f"r_{a}": F.when(F.col(f"o.{a}"), F.col(f"b_{a}")).otherwise(0.0) for a in names}})
    tried = tried.withColumns({"u12": F.try_divide("e12", "d1"), "u17": F.try_divide("e17", "d1")})
    tried = tried.withColumns({"d2": c[two, two] - F.col("u12") * F.col("e12"), "e27": c[two, seven] - F.col("u17") * F.col("e12"), "z2": F.col("r_l2") - F.col("u12") * F.col("r_l1")})
    tried = tried.withColumn("u27", F.try_divide("e27", "d2"))
    tried = tried.withColumns({"d7": c[seven, seven] - F.col("u17") * F.col("e17") - F.col("u27") * F.col("e27"), "z7": F.col("r_l7") - F.col("u17") * F.col("r_l1") - F.col("u27") * F.col("z2")})
    sound = F.lit(True)
    for a, d in zip(names, ("d1", "d2", "d7")):
        own = F.col(f"{a}_{a}")
        sound = sound & (~F.col(f"o.{a}") | ((own > 1e-12 * (F.col(f"m_{a}") * F.col(f"m_{a}") + F.col("vy"))) & (F.col(d) > 1e-9 * own)))
    tried = tried.where(F.coalesce(sound, F.lit(False)))
    tried = tried.withColumn("f7", F.col("z7") / F.col("d7"))
    tried = tried.withColumn("f2", F.col("z2") / F.col("d2") - F.col("u27") * F.col("f7"))
    tried = tried.withColumn("f1", F.col("r_l1") / F.col("d1") - F.col("u12") * F.col("f2") - F.col("u17") * F.col("f7"))
    tried = tried.withColumn("c", F.col("my") - F.col("f1") * F.col("m_l1") - F.col("f2") * F.col("m_l2") - F.col("f7") * F.col("m_l7"))
    explained = F.col("f1") * F.col("r_l1") + F.col("f2") * F.col("r_l2") + F.col("f7") * F.col("r_l7")
    size = F.col("o.l1").cast("int") + F.col("o.l2").cast("int") + F.col("o.l7").cast("int")
    tried = tried.withColumn("sse", F.greatest(F.col("n") * (F.col("vy") - explained), F.col("n") * 1e-12 * (F.col("vy") + F.col("my") * F.col("my")), F.lit(1e-300))).withColumn("size", size)
    k = F.col("size") + 2
    room = F.col("n") - k - 1
    criterion = F.col("n") * F.log(F.col("sse") / F.col("n")) + 2 * k + 2 * k * (k + 1) / F.when(room > 0, room)
    tried = tried.withColumn("aicc", F.when(F.col("size") == 0, F.coalesce(criterion, F.lit(1e300))).otherwise(criterion)).where("aicc IS NOT NULL")
    dev = F.sqrt(F.col("sse") / F.greatest(F.col("n") - F.col("size") - 1, F.lit(1.0)))
    best = tried.groupBy(*keys).agg(F.min_by(F.struct("c", "f1", "f2", "f7", (F.col("o.l1").cast("int") + F.col("o.l2").cast("int")).alias("p"), F.col("o.l7").alias("week"), dev.alias("dev")), F.struct("aicc", "o.k")).alias("b"))
    return best.select(*keys, "b.*")


def autoregressed(series: DataFrame, keys: list[str], end: dt.date, least: int, z: float) -> DataFrame:
    """The model ``ar``: autoregression on the last days and the day a week before, in built-in functions.

    The first week of a series has no fitted values. Forecasts follow from each other, as a fold over the horizon.
    """
    # read several times, and small beside what they come from
    series = durable(series.select(*keys, "date", "cost"), "series")
    rows = lagged(series, keys, max(least, 8))
    fitted = durable(fit_autoregression(rows, keys), "autoregression")
    step = F.col("c") + F.col("f1") * F.col("l1") + F.col("f2") * F.col("l2") + F.col("f7") * F.col("l7")
    past = rows.join(fitted, keys).select(*keys, "date", F.lit("fit").alias("kind"), "y", step.alias("yhat"), (step + z * F.col("dev")).alias("hi"))
    # the last week of each series, newest last
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date")))
    week = series.select(*keys, "date", "cost", place.alias("__p")).where("__p <= 7").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "cost"))).alias("__w"))
    last = week.select(*keys, F.element_at("__w", -1)["date"].alias("__last"), F.col("__w.cost").alias("__past")).join(fitted, keys)
    last = last.withColumn("__h", F.datediff(F.lit(end), "__last") - 1).where("__h > 0")

    def following(values: Column, _: Column) -> Column:
        at = {n: F.element_at(values, -n) for n in LAGS}
        return F.concat(values, F.array(F.col("c") + F.col("f1") * at[1] + F.col("f2") * at[2] + F.col("f7") * at[7]))

    ahead = last.withColumn("__all", F.aggregate(F.sequence(F.lit(1), F.col("__h")), F.col("__past"), following))
    ahead = ahead.select(*keys, "__last", "dev", F.posexplode(F.slice("__all", F.lit(8), F.col("__h"))).alias("__k", "yhat"))
    ahead = ahead.select(*keys, F.date_add("__last", F.col("__k") + 1).alias("date"), F.lit("forecast").alias("kind"), F.lit(None).cast("double").alias("y"), "yhat", (F.col("yhat") + z * F.col("dev")).alias("hi"))
    return past.union(ahead)


#: Forecast models by name; each takes (series, keys, end, least, z) and gives (keys, date, kind, y, yhat, hi).
MODELS: dict[str, Callable[..., DataFrame]] = {"ets": smoothed, "ar": autoregressed}


def forecast(series: DataFrame, keys: list[str], end: dt.date, least: int = 14, z: float = 1.96, model: str | Callable[..., DataFrame] = "ets", legacy_horizon: bool = False) -> DataFrame:
    """(keys, date, kind, y, yhat, hi): fitted values and forecasts up to ``end`` (exclusive) of every series.

    One job over all series; a series shorter than ``least`` days gets no rows. ``hi`` is the
    fitted value plus ``z`` residual deviations. ``model`` is a name in :data:`MODELS` or a function like those.
    ``legacy_horizon`` takes ``end`` in, as tools do that count the days from the cutoff to the next month's first.
    """
    end = end + dt.timedelta(days=1) if legacy_horizon else end
    if isinstance(model, str):
        if model not in MODELS:
            raise ValueError(f"no forecast model {model}")
        model = MODELS[model]
    return model(series, keys, end, least, z)


def anomaly_detect(fitted: DataFrame, keys: list[str], min_delta: float = 5.0) -> DataFrame:
    """Days whose cost exceeds the upper bound and the fitted value (at least 0) by more than ``min_delta``."""
    base = F.greatest(F.lit(0.0), F.col("yhat"))
    hit = fitted.where((F.col("y") > F.col("hi")) & (F.col("y") - base > min_delta))
    return hit.select(*keys, F.col("date").alias("anomaly_date"), F.lit("cost").alias("anomaly_type"), F.col("y").alias("actual_cost"), base.alias("predicted_cost"), F.col("hi").alias("threshold"), (F.col("y") - base).alias("delta"))


def budget_breach(days: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Budget anomalies of a month.

    ``days`` has (keys, date, value, is_forecast) for the month, ``limits`` (keys, limit_amount). If
    the month's sum exceeds the limit: one anomaly on the last forecast day; and one on the first
    forecast day on which the running sum passes the limit, unless actual costs passed it already.
    """
    running = F.sum("value").over(W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    rows = days.withColumn("__sum", running).join(limits, keys)
    over = F.col("__sum") > F.col("limit_amount")
    per = rows.groupBy(*keys).agg(
        F.max("limit_amount").alias("threshold"),
        F.sum("value").alias("projected"),
        F.max(F.when(F.col("is_forecast"), F.col("date"))).alias("last_day"),
        F.min(F.when(over, F.col("date"))).alias("first_over"),
        F.min(F.when(F.col("is_forecast"), F.col("date"))).alias("first_forecast"),
    )
    per = per.where("projected > threshold AND last_day IS NOT NULL")
    day = F.explode(F.array_distinct(F.when(F.col("first_over") >= F.col("first_forecast"), F.array("last_day", "first_over")).otherwise(F.array("last_day"))))
    return per.select(*keys, day.alias("anomaly_date"), F.lit("budget").alias("anomaly_type"), F.col("projected").alias("actual_cost"), "threshold", (F.col("projected") - F.col("threshold")).alias("delta"))


def forecast_latest(history: DataFrame, keys: list[str], month: dt.date, since: dt.date) -> DataFrame:
    """The newest forecast of a month made since a day."""
    rows = history.where((F.col("target_month") == F.lit(month)) & (F.col("forecast_date") >= F.lit(since)))
    return rows.groupBy(*keys).agg(F.max("forecast_date").alias("forecast_date"), F.max_by("projected_amount", "forecast_date").alias("projected_amount"))


def forecast_quality(history: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of all projections against the latest one, per scope and month: variance and accuracy in percent."""
    per = history.groupBy(*keys, "target_month").agg(F.avg("projected_amount").alias("projected"), F.max_by("projected_amount", "forecast_date").alias("actual"), F.count(F.lit(1)).alias("snapshots"))
    variance = F.col("actual") - F.col("projected")
    close = 100.0 - F.least(F.lit(100.0), F.abs(variance) / F.col("projected") * 100.0)
    accuracy = F.when(F.col("projected") > 0, close).otherwise(F.when(F.col("actual") == 0, 100.0).otherwise(0.0))
    return per.select("*", variance.alias("variance"), accuracy.alias("accuracy"))


def with_daily_actuals(quality: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """``quality`` (keys, target_month, others) with the month's ``daily_actuals``: (date, cost) in order, empty without costs.

    ``daily`` has (keys, date, cost), one row per key and day, so an array has at most 31 items.
    """
    days = daily.groupBy(*keys, F.trunc("date", "month").alias("target_month")).agg(F.array_sort(F.collect_list(F.struct("date", "cost"))).alias("daily_actuals"))
    rows = quality.join(days, [*keys, "target_month"], "left")
    none = F.array().cast("array<struct<date:date,cost:double>>")
    return rows.withColumn("daily_actuals", F.coalesce("daily_actuals", none))


def mean_daily_forecast(history: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, mean): the mean over snapshots of ``daily_forecasts`` maps; a day that a snapshot lacks counts 0."""
    counts = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    sums = history.select(*keys, F.explode("daily_forecasts").alias("day", "value")).groupBy(*keys, "day").agg(F.sum("value").alias("__s"))
    return sums.join(counts, keys).select(*keys, "day", (F.col("__s") / F.col("__n")).alias("mean"))


def forecast_quality_vectors(forecasts: DataFrame, actuals: DataFrame, keys: list[str], today: dt.date) -> DataFrame:
    """Running sums of forecasts (actual costs where there is none) and of actual costs (null after today)."""
    rows = forecasts.join(actuals, [*keys, "date"], "full")
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    cost = F.coalesce("cost", F.lit(0.0))
    actual = F.sum(cost).over(w)
    return rows.select(*keys, "date", F.sum(F.coalesce("predicted", cost)).over(w).alias("forecast_cumulative"), F.when(F.col("date") <= F.lit(today), actual).alias("actual_cumulative"))


def anomalies_for_month(anomalies: DataFrame, keys: list[str], start: dt.date, end: dt.date) -> DataFrame:
    """One anomaly per scope and day of [start, end): cost before budget."""
    rows = anomalies.where((F.col("anomaly_date") >= F.lit(start)) & (F.col("anomaly_date") < F.lit(end)))
    place = F.when(F.col("anomaly_type") == "cost", 0).otherwise(1)
    return rows.groupBy(*keys, "anomaly_date").agg(*[F.min_by(c, place).alias(c) for c in ("anomaly_type", "actual_cost", "threshold", "is_seen")])


def anomalies_dashboard(anomalies: DataFrame, entities: DataFrame, start: dt.date, end: dt.date, only_unseen: bool = False) -> DataFrame:
    """Anomalies of [start, end] with the scope's name, newest first."""
    rows = anomalies.where(F.col("anomaly_date").between(F.lit(start), F.lit(end)))
    rows = rows.where(~F.col("is_seen")) if only_unseen else rows
    named = rows.join(entities.select(F.col("id").alias("scope_id"), F.col("name").alias("__name")), "scope_id", "left")
    name = F.coalesce("__name", F.concat(F.lit("Scope "), F.col("scope_id").cast("string")))
    return named.select("scope_id", name.alias("scope_name"), "anomaly_date", "anomaly_type", "actual_cost", "threshold", "is_seen").orderBy(F.desc("anomaly_date"), "scope_id", "anomaly_type")


def anomaly_entry(actual: Column, threshold: Column, least: float = 4.0) -> Column:
    """A day's display record: whether the cost exceeds its threshold, and by how much."""
    hit = (actual > threshold) & (actual > least)
    return F.struct(F.coalesce(hit, F.lit(False)).alias("is_anomaly"), actual.alias("actual"), threshold.alias("threshold"), F.coalesce(F.greatest(F.lit(0.0), actual - threshold), F.lit(0.0)).alias("delta"))
