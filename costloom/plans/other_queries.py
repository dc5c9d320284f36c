"""Registered queries on budgets, forecasts, metrics, rightsizing, sources, upserts and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from costloom.functions import normalize as N
from costloom.functions.tables import durable
from costloom.functions.tags import tags_contain, tags_key
from costloom.functions.timegrid import align, iso_period_minutes
from costloom.operators import budgets as B
from costloom.operators import costs as C
from costloom.operators import hierarchy as H
from costloom.operators import metrics as M
from costloom.operators import refresh as Y
from costloom.operators import retention as Z
from costloom.operators import rightsizing as R
from costloom.operators import upsert as U
from costloom.plans.catalog import AS_OF, END, EUR_SQL, METRICS_AS_OF, RATE, START, query, rounded
from costloom.sources import focus as X
from costloom.sources import payloads as P
from costloom.streaming import ingest as S

SCOPE = ["scope_id"]

# budgets and forecasts


@query("budget_asof", "WITH s AS (SELECT DISTINCT scope_id, target_month AS month FROM forecast_history) SELECT s.scope_id, s.month, round(arg_max(limit_amount, b.month), 4) AS limit_amount FROM s JOIN budgets b ON b.scope_id = s.scope_id AND b.month <= s.month GROUP BY 1, 2")
def budget_asof(v):
    wanted = v.forecast_history.select("scope_id", F.col("target_month").alias("month")).distinct()
    return rounded(B.budget_asof(v.budgets, wanted, SCOPE), "limit_amount")


@query("usd_to_eur_rates", """
    WITH rates AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'USD' ELSE 'GBP' END AS currency, CAST(o_orderdate AS DATE) AS date, round(max(o_totalprice) / 400000, 4) AS rate FROM orders WHERE o_orderkey % 50 = 0 AND o_orderdate >= DATE '1993-03-01' GROUP BY 1, 2),
    d AS (SELECT currency, charge_date, arg_max(rate, date) AS rate FROM (SELECT DISTINCT currency, charge_date FROM costs WHERE currency <> 'EUR') JOIN rates USING (currency) WHERE date <= charge_date GROUP BY 1, 2)
    SELECT charge_date, currency, count(*) AS n, count(CASE WHEN currency = 'EUR' THEN 1.0 ELSE rate END) AS converted, round(sum(billed_cost * CASE WHEN currency = 'EUR' THEN 1.0 ELSE rate END), 3) AS cost_eur FROM costs LEFT JOIN d USING (currency, charge_date) GROUP BY 1, 2""")
def usd_to_eur_rates(v):
    """Costs of a day and currency by the newest exchange rate at or before the day."""
    currency = F.when(F.col("o_orderstatus") == "F", "USD").otherwise("GBP")
    rates = v.orders.where("o_orderkey % 50 = 0 AND o_orderdate >= DATE '1993-03-01'").groupBy(currency.alias("currency"), F.col("o_orderdate").cast("date").alias("date")).agg(F.round(F.max("o_totalprice") / 400000, 4).alias("rate"))
    costs = v.costs.groupBy("charge_date", "currency").agg(F.count(F.lit(1)).alias("n"), F.sum("billed_cost").alias("billed_cost"))
    rows = B.in_euro(costs, rates)
    return rows.select("charge_date", "currency", "n", F.when(F.col("rate").isNotNull(), F.col("n")).otherwise(F.lit(0)).cast("long").alias("converted"), F.round("cost_eur", 3).alias("cost_eur"))


@query("budget_active_scopes", f"SELECT DISTINCT scope_id FROM budgets WHERE month <= DATE '{START}'")
def budget_active_scopes(v):
    return B.budget_active_scopes(v.budgets, START, SCOPE)


@query("budget_set", "WITH n AS (SELECT scope_id, target_month AS month, round(max(projected_amount), 4) AS limit_amount FROM forecast_history WHERE month(target_month) IN (1, 2) GROUP BY 1, 2) SELECT coalesce(n.scope_id, b.scope_id) AS scope_id, coalesce(n.month, b.month) AS month, round(coalesce(n.limit_amount, b.limit_amount), 4) AS limit_amount FROM budgets b FULL JOIN n ON n.scope_id = b.scope_id AND n.month = b.month")
def budget_set(v):
    new = v.forecast_history.where("month(target_month) IN (1, 2)").groupBy("scope_id", F.col("target_month").alias("month")).agg(F.round(F.max("projected_amount"), 4).alias("limit_amount"))
    return rounded(U.upsert(v.budgets, new, ["scope_id", "month"], {"limit_amount": "replace"}), "limit_amount")


@query("cutoff_date", f"SELECT entity_id, max(charge_date) AS max_date, least(max(charge_date), DATE '{AS_OF}' - 1) AS cutoff FROM costs WHERE charge_date >= DATE '{START}' AND charge_date < DATE '{END}' GROUP BY 1")
def cutoff_date(v):
    inside = v.costs.where((F.col("charge_date") >= F.lit(START)) & (F.col("charge_date") < F.lit(END)))
    return B.cutoff_date(inside.groupBy("entity_id").agg(F.max("charge_date").alias("max_date")), AS_OF)


def cluster_daily(v):
    """Daily EUR costs of every cluster's machines over 35 days and a month, gaps filled."""
    start = START - dt.timedelta(days=35)
    parents = v.entities.select(F.col("id").alias("entity_id"), F.col("parent_id").alias("scope_id"))
    sums = C.entity_daily(v.costs, start, END, RATE).join(parents, "entity_id").groupBy("scope_id", "date").agg(F.sum("cost").alias("cost"))
    clusters = v.entities.where("type = 'kubernetes_cluster'").select(F.col("id").alias("scope_id"))
    return C.gap_filled(clusters, sums, SCOPE, start, END, "cost")


CLUSTER_DAILY_SQL = f"""
    days AS (SELECT unnest(generate_series(DATE '{START}' - 35, DATE '{END}' - 1, INTERVAL 1 DAY))::DATE AS date),
    cluster_daily AS (SELECT e.id AS scope_id, d.date, coalesce(sum(x.cost), 0) AS cost FROM entities e CROSS JOIN days d LEFT JOIN (SELECT parent_id, charge_date, billed_cost * CASE WHEN currency = 'USD' THEN {RATE} ELSE 1.0 END AS cost FROM costs JOIN entities v ON v.id = entity_id) x ON x.parent_id = e.id AND x.charge_date = d.date WHERE e.type = 'kubernetes_cluster' GROUP BY 1, 2)"""
CUTOFF = dt.date(1996, 7, 20)


@query("series_prepare", f"WITH {CLUSTER_DAILY_SQL} SELECT c.scope_id, date, round(cost, 4) AS cost FROM cluster_daily c JOIN (SELECT scope_id, min(date) AS first FROM cluster_daily WHERE cost > 0 GROUP BY 1) f USING (scope_id) WHERE date >= first AND date <= DATE '{CUTOFF}'")
def series_prepare(v):
    return rounded(B.series_prepare(cluster_daily(v), SCOPE, CUTOFF), "cost")


@query("forecast_sma", f"WITH {CLUSTER_DAILY_SQL}, m AS (SELECT scope_id, avg(cost) AS predicted FROM cluster_daily WHERE date > DATE '{CUTOFF}' - 7 AND date <= DATE '{CUTOFF}' GROUP BY 1) SELECT c.scope_id, date, round(predicted, 4) AS predicted FROM cluster_daily c JOIN m USING (scope_id) WHERE date > DATE '{CUTOFF}' AND date < DATE '{END}' AND EXISTS (SELECT 1 FROM cluster_daily x WHERE x.scope_id = c.scope_id AND x.cost > 0 AND x.date <= DATE '{CUTOFF}')")
def forecast_sma(v):
    return rounded(B.forecast_sma(B.series_prepare(cluster_daily(v), SCOPE, CUTOFF), SCOPE, (END - CUTOFF).days - 1), "predicted")


#: The prepared series with their numbering from 0.
SERIES_SQL = f"""{CLUSTER_DAILY_SQL},
    begun AS (SELECT scope_id, min(date) AS first FROM cluster_daily WHERE cost > 0 GROUP BY 1),
    ser AS (SELECT scope_id, date, cost AS y, row_number() OVER (PARTITION BY scope_id ORDER BY date) - 1 AS t, count(*) OVER (PARTITION BY scope_id) AS days FROM cluster_daily JOIN begun USING (scope_id) WHERE date >= first AND date <= DATE '{CUTOFF}')"""
#: Additive smoothing with a weekly season for twelve settings, as a recursion over days.
ETS_SQL = f"""{SERIES_SQL},
    grid AS (SELECT row_number() OVER (ORDER BY a, b, g) AS k, a, b, g FROM (SELECT unnest([0.1, 0.3, 0.6])::DOUBLE AS a), (SELECT unnest([0.0, 0.1])::DOUBLE AS b), (SELECT unnest([0.05, 0.3])::DOUBLE AS g)),
    start AS (SELECT scope_id, avg(y) AS level, list(y ORDER BY t) AS ys FROM ser WHERE t < 7 AND days >= 14 GROUP BY 1),
    st AS (
      SELECT scope_id, k, CAST(-1 AS BIGINT) AS t, level, CAST(0 AS DOUBLE) AS trend, [ys[i] - level FOR i IN range(1, 8)] AS cycle, CAST(0 AS DOUBLE) AS sse, CAST(NULL AS DOUBLE) AS fit FROM start, grid
      UNION ALL
      SELECT scope_id, k, t, level + trend + a * e, trend + a * b * e, [CASE WHEN i = t % 7 + 1 THEN s + g * e ELSE cycle[i] END FOR i IN range(1, 8)], sse + e * e, fit
      FROM (SELECT *, y - fit AS e FROM (SELECT st.scope_id, st.k, ser.t, level, trend, cycle, sse, y, a, b, g, cycle[ser.t % 7 + 1] AS s, level + trend + cycle[ser.t % 7 + 1] AS fit
        FROM st JOIN ser ON ser.scope_id = st.scope_id AND ser.t = st.t + 1 JOIN grid ON grid.k = st.k))
    ),
    best AS (SELECT scope_id, arg_min(k, (sse, k)) AS k, max(t) AS last_t FROM st JOIN (SELECT scope_id, max(t) AS last_t FROM st GROUP BY 1) USING (scope_id) WHERE t = last_t GROUP BY 1),
    final AS (SELECT st.*, sqrt(sse / greatest(1, t + 1 - 3)) AS dev FROM st JOIN best ON best.scope_id = st.scope_id AND best.k = st.k AND best.last_t = st.t),
    ahead AS (SELECT scope_id, DATE '{CUTOFF}' + CAST(h + 1 AS INT) AS date, level + (h + 1) * trend + cycle[(t + 1 + h) % 7 + 1] AS yhat, dev FROM final, (SELECT unnest(range({(END - CUTOFF).days - 1})) AS h)),
    fitted AS (
      SELECT s.scope_id, ser.date, 'fit' AS kind, ser.y, s.fit AS yhat, s.fit + 1.96 * dev AS hi FROM st s JOIN best ON best.scope_id = s.scope_id AND best.k = s.k JOIN ser ON ser.scope_id = s.scope_id AND ser.t = s.t JOIN final f ON f.scope_id = s.scope_id
      UNION ALL SELECT scope_id, date, 'forecast', NULL, yhat, yhat + 1.96 * dev FROM ahead)"""
#: Autoregression on days 1, 2 and 7 before, by determinants, for six orders; then a recursion over the days ahead.
AR_SQL = f"""{SERIES_SQL},
    x AS (SELECT * FROM (SELECT scope_id, date, y, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 7) OVER w AS l7 FROM ser WHERE days >= 14 WINDOW w AS (PARTITION BY scope_id ORDER BY t)) WHERE l7 IS NOT NULL),
    sums AS (SELECT scope_id, count(*)::DOUBLE AS n, avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, avg(l7) AS m7, var_pop(y) AS vy, covar_pop(l1, y) AS b1, covar_pop(l2, y) AS b2, covar_pop(l7, y) AS b7,
      var_pop(l1) AS c11, var_pop(l2) AS c22, var_pop(l7) AS c77, covar_pop(l1, l2) AS c12, covar_pop(l1, l7) AS c17, covar_pop(l2, l7) AS c27 FROM x GROUP BY 1),
    ord AS (SELECT k, k % 3 AS p, k // 3 AS w, CASE WHEN k % 3 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS i1, CASE WHEN k % 3 > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS i2, (k // 3)::DOUBLE AS i7 FROM (SELECT unnest(range(6)) AS k)),
    sys AS (SELECT scope_id, k, p, w, n, my, m1, m2, m7, vy, i1 * b1 AS r1, i2 * b2 AS r2, i7 * b7 AS r7, i1 * c11 + 1 - i1 AS a, i2 * c22 + 1 - i2 AS e, i7 * c77 + 1 - i7 AS h, i1 * i2 * c12 AS b, i1 * i7 * c17 AS c, i2 * i7 * c27 AS f,
      (i1 = 0 OR c11 > 1e-12 * (m1 * m1 + vy)) AND (i2 = 0 OR c22 > 1e-12 * (m2 * m2 + vy)) AND (i7 = 0 OR c77 > 1e-12 * (m7 * m7 + vy)) AS varied FROM sums, ord),
    det AS (SELECT *, a * e - b * b AS d2, a * (e * h - f * f) - b * (b * h - f * c) + c * (b * f - e * c) AS d3 FROM sys WHERE varied),
    sol AS (SELECT *, (r1 * (e * h - f * f) - b * (r2 * h - f * r7) + c * (r2 * f - e * r7)) / d3 AS f1, (a * (r2 * h - f * r7) - r1 * (b * h - f * c) + c * (b * r7 - r2 * c)) / d3 AS f2, (a * (e * r7 - r2 * f) - b * (b * r7 - r2 * c) + r1 * (b * f - e * c)) / d3 AS f7
      FROM det WHERE d2 / a > 1e-9 * e AND d3 / d2 > 1e-9 * h),
    crit AS (SELECT *, my - f1 * m1 - f2 * m2 - f7 * m7 AS const, greatest(n * (vy - f1 * r1 - f2 * r2 - f7 * r7), n * 1e-12 * (vy + my * my), 1e-300) AS sse FROM sol WHERE p + w = 0 OR n - (p + w + 2) - 1 > 0),
    best AS (SELECT scope_id, unnest(arg_min({{'const': const, 'f1': f1, 'f2': f2, 'f7': f7, 'p': p, 'w': w, 'dev': sqrt(sse / greatest(n - p - w - 1, 1))}},
      (CASE WHEN n - (p + w + 2) - 1 > 0 THEN n * ln(sse / n) + 2 * (p + w + 2) + 2 * (p + w + 2) * (p + w + 3) / (n - p - w - 3) ELSE 1e300 END, k))) FROM crit GROUP BY 1),
    steps AS (
      SELECT scope_id, CAST(0 AS BIGINT) AS h, list(y ORDER BY t) AS ys FROM ser WHERE t >= days - 7 AND days >= 14 GROUP BY 1
      UNION ALL SELECT scope_id, h + 1, list_append(ys, const + f1 * ys[-1] + f2 * ys[-2] + f7 * ys[-7]) FROM steps JOIN best USING (scope_id) WHERE h < {(END - CUTOFF).days - 1}),
    fitted AS (
      SELECT scope_id, date, 'fit' AS kind, y, const + f1 * l1 + f2 * l2 + f7 * l7 AS yhat, const + f1 * l1 + f2 * l2 + f7 * l7 + 1.96 * dev AS hi FROM x JOIN best USING (scope_id)
      UNION ALL SELECT scope_id, DATE '{CUTOFF}' + CAST(h AS INT), 'forecast', NULL, ys[-1], ys[-1] + 1.96 * dev FROM steps JOIN best USING (scope_id) WHERE h > 0)"""
FITTED_SQL = "SELECT scope_id, date, kind, round(y, 4) AS y, round(yhat, 4) AS yhat, round(hi, 4) AS hi FROM fitted"


def fitted_rows(v, model: str):
    return B.forecast(B.series_prepare(cluster_daily(v), SCOPE, CUTOFF), SCOPE, END, model=model)


@query("forecast_ets", f"WITH RECURSIVE {ETS_SQL} {FITTED_SQL}")
def forecast_ets(v):
    return rounded(fitted_rows(v, "ets"), "y", "yhat", "hi")


@query("forecast_arima_fbad", f"WITH RECURSIVE {AR_SQL} SELECT scope_id, date, round(greatest(yhat, 0), 4) AS predicted FROM fitted WHERE kind = 'forecast'")
def forecast_arima_fbad(v):
    rows = fitted_rows(v, "ar").where("kind = 'forecast'")
    return rounded(rows.select("scope_id", "date", F.greatest("yhat", F.lit(0.0)).alias("predicted")), "predicted")


@query("forecast_models", f"WITH RECURSIVE {AR_SQL} SELECT scope_id, CAST(p AS INT) AS p, w = 1 AS week, round(const, 4) AS c, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f7, 6) AS f7, round(dev, 4) AS dev FROM best")
def forecast_models(v):
    """The order and coefficients that the autoregressive model picks for every scope."""
    series = B.series_prepare(cluster_daily(v), SCOPE, CUTOFF)
    return rounded(rounded(B.fit_autoregression(B.lagged(series, SCOPE, 14), SCOPE), "c", "dev"), "f1", "f2", "f7", digits=6)


ANOMALY_SQL = "SELECT scope_id, date AS anomaly_date, 'cost' AS anomaly_type, round(y, 4) AS actual_cost, round(greatest(yhat, 0), 4) AS predicted_cost, round(hi, 4) AS threshold, round(y - greatest(yhat, 0), 4) AS delta FROM fitted WHERE y > hi AND y - greatest(yhat, 0) > 5"


@query("anomaly_detect", f"WITH RECURSIVE {ETS_SQL} {ANOMALY_SQL}")
def anomaly_detect(v):
    return rounded(B.anomaly_detect(fitted_rows(v, "ets"), SCOPE), "actual_cost", "predicted_cost", "threshold", "delta")


def month_days(v):
    """Actual costs up to the cutoff and the moving-average forecast after it."""
    daily = cluster_daily(v)
    past = daily.where(F.col("date").between(F.lit(START), F.lit(CUTOFF))).select("scope_id", "date", F.col("cost").alias("value"), F.lit(False).alias("is_forecast"))
    ahead = B.forecast_sma(B.series_prepare(daily, SCOPE, CUTOFF), SCOPE, (END - CUTOFF).days - 1)
    return past.union(ahead.select("scope_id", "date", F.col("predicted").alias("value"), F.lit(True).alias("is_forecast")))


@query("budget_breach", f"""
    WITH {CLUSTER_DAILY_SQL}, lim AS (SELECT scope_id, arg_max(limit_amount, month) * 0.5 AS threshold FROM budgets WHERE month <= DATE '{START}' GROUP BY 1),
    m AS (SELECT scope_id, avg(cost) AS p FROM cluster_daily WHERE date > DATE '{CUTOFF}' - 7 AND date <= DATE '{CUTOFF}' GROUP BY 1),
    days2 AS (SELECT scope_id, date, CASE WHEN date <= DATE '{CUTOFF}' THEN cost ELSE p END AS value FROM cluster_daily JOIN m USING (scope_id) WHERE date >= DATE '{START}'),
    r AS (SELECT *, sum(value) OVER (PARTITION BY scope_id ORDER BY date) AS total FROM days2 JOIN lim USING (scope_id)),
    g AS (SELECT scope_id, max(threshold) AS threshold, max(total) AS projected, min(CASE WHEN total > threshold THEN date END) AS first_over FROM r GROUP BY 1)
    SELECT scope_id, DATE '{END}' - 1 AS anomaly_date, 'budget' AS anomaly_type, round(projected, 4) AS actual_cost, round(threshold, 4) AS threshold FROM g WHERE projected > threshold
    UNION SELECT scope_id, first_over, 'budget', round(projected, 4), round(threshold, 4) FROM g WHERE projected > threshold AND first_over > DATE '{CUTOFF}'""")
def budget_breach(v):
    limits = B.budget_asof(v.budgets, v.budgets.select("scope_id").distinct().withColumn("month", F.lit(START)), SCOPE).select("scope_id", (F.col("limit_amount") * 0.5).alias("limit_amount"))
    return rounded(B.budget_breach(month_days(v), limits, SCOPE).drop("delta"), "actual_cost", "threshold")


@query("fbad_job", f"""
    WITH RECURSIVE {AR_SQL}, lim AS (SELECT scope_id, arg_max(limit_amount, month) AS threshold FROM budgets WHERE month <= DATE '{START}' GROUP BY 1),
    days2 AS (SELECT scope_id, date, y AS value, false AS ahead FROM ser WHERE date >= DATE '{START}' UNION ALL SELECT scope_id, date, greatest(yhat, 0), true FROM fitted WHERE kind = 'forecast'),
    r AS (SELECT *, sum(value) OVER (PARTITION BY scope_id ORDER BY date) AS total FROM days2 JOIN lim USING (scope_id)),
    g AS (SELECT scope_id, max(threshold) AS threshold, max(total) AS projected, max(CASE WHEN ahead THEN date END) AS last_day, min(CASE WHEN ahead THEN date END) AS first_ahead, min(CASE WHEN total > threshold THEN date END) AS first_over FROM r GROUP BY 1)
    SELECT scope_id, anomaly_date, anomaly_type, actual_cost, threshold, delta FROM ({ANOMALY_SQL}) WHERE scope_id IN (SELECT scope_id FROM lim)
    UNION ALL SELECT DISTINCT scope_id, unnest(CASE WHEN first_over >= first_ahead THEN [last_day, first_over] ELSE [last_day] END), 'budget', round(projected, 4), round(threshold, 4), round(projected - threshold, 4) FROM g WHERE projected > threshold AND last_day IS NOT NULL""")
def fbad_job(v):
    """The nightly pass: forecasts of all budgeted scopes, cost anomalies and budget breaches."""
    active = B.budget_active_scopes(v.budgets, START, SCOPE)
    series = durable(B.series_prepare(cluster_daily(v).join(active, SCOPE, "left_semi"), SCOPE, CUTOFF), "series")
    rows = durable(B.forecast(series, SCOPE, END, model="ar"), "fitted")
    past = series.where(F.col("date") >= F.lit(START)).select("scope_id", "date", F.col("cost").alias("value"), F.lit(False).alias("is_forecast"))
    ahead = rows.where("kind = 'forecast'").select("scope_id", "date", F.greatest("yhat", F.lit(0.0)).alias("value"), F.lit(True).alias("is_forecast"))
    limits = B.budget_asof(v.budgets, active.withColumn("month", F.lit(START)), SCOPE).drop("month")
    breaches = B.budget_breach(past.union(ahead), limits, SCOPE)
    found = B.anomaly_detect(rows, SCOPE).drop("predicted_cost")
    return rounded(found.unionByName(breaches), "actual_cost", "threshold", "delta")


#: The budgets of tagged scopes: each cluster's machines alone and those of one tier, with a part of the limit.
BUDGET_TAGS = [({}, 1.0), ({"tier": "gold"}, 0.3)]
TAGGED_SQL = CLUSTER_DAILY_SQL.replace("cluster_daily AS (SELECT e.id AS scope_id,", "cluster_daily AS (SELECT concat(e.id, '|', tags_key) AS scope_id,").replace("FROM entities e CROSS JOIN days d", """FROM entities e CROSS JOIN days d CROSS JOIN (VALUES ('{}', NULL), ('{"tier":"gold"}', 'gold')) AS w(tags_key, w_tier)""").replace("SELECT parent_id, charge_date,", "SELECT parent_id, tier, charge_date,").replace("x.charge_date = d.date", "x.charge_date = d.date AND (w_tier IS NULL OR x.tier = w_tier)")


def tagged_scopes(v, clusters, *more):
    """Every budgeted tag set of clusters (scope_id), with its part of the limit."""
    sets = F.array(*[F.struct(F.create_map(*[F.lit(x) for pair in t.items() for x in pair]).cast("map<string,string>").alias("tags"), F.lit(part).alias("part")) for t, part in BUDGET_TAGS])
    return clusters.select("scope_id", *more, F.explode(sets).alias("w")).select("scope_id", *more, "w.tags", "w.part").withColumn("tags_key", tags_key(F.col("tags")))


def tagged_daily(v):
    """Daily EUR costs of every cluster's machines that hold each budgeted tag set."""
    start = START - dt.timedelta(days=35)
    clusters = v.entities.where("type = 'kubernetes_cluster'").select(F.col("id").alias("scope_id"))
    scopes = tagged_scopes(v, clusters)
    own = v.entities.select(F.col("id").alias("entity_id"), F.col("parent_id").alias("scope_id"), F.col("tags").alias("own_tags"))
    members = own.join(scopes, "scope_id").where(tags_contain(F.col("own_tags"), F.col("tags"))).select("entity_id", "scope_id", "tags_key")
    sums = C.entity_daily(v.costs, start, END, RATE).join(members, "entity_id").groupBy("scope_id", "tags_key", "date").agg(F.sum("cost").alias("cost"))
    return C.gap_filled(scopes.select("scope_id", "tags_key"), sums, ["scope_id", "tags_key"], start, END, "cost")


@query("fbad_job_tags", f"""
    WITH RECURSIVE {AR_SQL.replace(CLUSTER_DAILY_SQL, TAGGED_SQL)},
    lim AS (SELECT concat(scope_id, '|', tags_key) AS scope_id, arg_max(limit_amount, month) * any_value(part) AS threshold FROM budgets CROSS JOIN (VALUES ('{{}}', 1.0), ('{{"tier":"gold"}}', 0.3)) AS w(tags_key, part) WHERE month <= DATE '{START}' GROUP BY budgets.scope_id, tags_key),
    days2 AS (SELECT scope_id, date, y AS value, false AS ahead FROM ser WHERE date >= DATE '{START}' UNION ALL SELECT scope_id, date, greatest(yhat, 0), true FROM fitted WHERE kind = 'forecast'),
    r AS (SELECT *, sum(value) OVER (PARTITION BY scope_id ORDER BY date) AS total FROM days2 JOIN lim USING (scope_id)),
    g AS (SELECT scope_id, max(threshold) AS threshold, max(total) AS projected, max(CASE WHEN ahead THEN date END) AS last_day, min(CASE WHEN ahead THEN date END) AS first_ahead, min(CASE WHEN total > threshold THEN date END) AS first_over FROM r GROUP BY 1),
    found AS (SELECT scope_id, anomaly_date, anomaly_type, actual_cost, threshold, delta FROM ({ANOMALY_SQL}) WHERE scope_id IN (SELECT scope_id FROM lim)
      UNION ALL SELECT DISTINCT scope_id, unnest(CASE WHEN first_over >= first_ahead THEN [last_day, first_over] ELSE [last_day] END), 'budget', round(projected, 4), round(threshold, 4), round(projected - threshold, 4) FROM g WHERE projected > threshold AND last_day IS NOT NULL)
    SELECT split_part(scope_id, '|', 1)::BIGINT AS scope_id, split_part(scope_id, '|', 2) AS tags_key, anomaly_date, anomaly_type, actual_cost, threshold, delta FROM found""")
def fbad_job_tags(v):
    """The nightly pass over budgets of scopes and tags: every step is keyed by both."""
    keys = ["scope_id", "tags_key"]
    budgets = tagged_scopes(v, v.budgets, "month", "limit_amount").withColumn("limit_amount", F.col("limit_amount") * F.col("part"))
    active = B.budget_active_scopes(budgets, START, keys)
    series = durable(B.series_prepare(tagged_daily(v).join(active, keys, "left_semi"), keys, CUTOFF), "series")
    rows = durable(B.forecast(series, keys, END, model="ar"), "fitted")
    past = series.where(F.col("date") >= F.lit(START)).select(*keys, "date", F.col("cost").alias("value"), F.lit(False).alias("is_forecast"))
    ahead = rows.where("kind = 'forecast'").select(*keys, "date", F.greatest("yhat", F.lit(0.0)).alias("value"), F.lit(True).alias("is_forecast"))
    limits = B.budget_asof(budgets, active.withColumn("month", F.lit(START)), keys).drop("month")
    found = B.anomaly_detect(rows, keys).drop("predicted_cost").unionByName(B.budget_breach(past.union(ahead), limits, keys))
    return rounded(found, "actual_cost", "threshold", "delta")


@query("forecast_save", "WITH n AS (SELECT scope_id, target_month, forecast_date, projected_amount * 2 AS p FROM forecast_history WHERE day(forecast_date) % 2 = 0) SELECT f.scope_id, f.target_month, f.forecast_date, round(coalesce(n.p, f.projected_amount), 4) AS projected_amount FROM forecast_history f LEFT JOIN n ON n.scope_id = f.scope_id AND n.target_month = f.target_month AND n.forecast_date = f.forecast_date")
def forecast_save(v):
    new = v.forecast_history.where("day(forecast_date) % 2 = 0").withColumn("projected_amount", F.col("projected_amount") * 2)
    return rounded(U.upsert(v.forecast_history, new, ["scope_id", "target_month", "forecast_date"], {"projected_amount": "replace"}), "projected_amount")


@query("forecast_latest", f"SELECT scope_id, max(forecast_date) AS forecast_date, round(arg_max(projected_amount, forecast_date), 4) AS projected_amount FROM forecast_history WHERE target_month = DATE '{START}' AND forecast_date >= DATE '1996-07-15' GROUP BY 1")
def forecast_latest(v):
    return rounded(B.forecast_latest(v.forecast_history, SCOPE, START, dt.date(1996, 7, 15)), "projected_amount")


QUALITY_SQL = "SELECT scope_id, target_month, avg(projected_amount) AS p, arg_max(projected_amount, forecast_date) AS a, count(*) AS snapshots FROM forecast_history GROUP BY 1, 2"


@query("forecast_quality", f"""
    WITH daily AS (SELECT e.parent_id AS scope_id, CAST(date_trunc('month', charge_date) AS DATE) AS target_month, charge_date, sum(billed_cost) AS cost FROM (SELECT entity_id, charge_date, {EUR_SQL.replace(str(RATE), "1.0")} AS billed_cost FROM costs) JOIN entities e ON e.id = entity_id GROUP BY 1, 2, 3),
    spent AS (SELECT scope_id, target_month, count(*) AS actual_days, min(charge_date) AS first_day, sum(cost) AS spent FROM daily GROUP BY 1, 2)
    SELECT scope_id, target_month, round(p, 4) AS projected, round(a, 4) AS actual, snapshots, round(a - p, 4) AS variance, round(100.0 - least(100.0, abs(a - p) / p * 100.0), 4) AS accuracy, coalesce(actual_days, 0) AS actual_days, first_day, round(coalesce(spent, 0), 3) AS spent
    FROM ({QUALITY_SQL}) LEFT JOIN spent USING (scope_id, target_month)""")
def forecast_quality(v):
    parents = v.entities.select(F.col("id").alias("entity_id"), F.col("parent_id").alias("scope_id"))
    months = v.forecast_history.select("scope_id", "target_month").distinct()
    daily = C.entity_daily(v.costs, None, None, 1.0).join(parents, "entity_id").groupBy("scope_id", "date").agg(F.sum("cost").alias("cost"))
    # of months without a forecast no actuals are asked for
    daily = daily.withColumn("target_month", F.trunc("date", "month")).join(months, ["scope_id", "target_month"], "left_semi").drop("target_month")
    rows = B.with_daily_actuals(B.forecast_quality(v.forecast_history, SCOPE), daily, SCOPE)
    spent = F.aggregate("daily_actuals", F.lit(0.0), lambda a, x: a + x["cost"])
    rows = rows.select("*", F.size("daily_actuals").cast("long").alias("actual_days"), F.get("daily_actuals", F.lit(0))["date"].alias("first_day"), spent.alias("spent")).drop("daily_actuals")
    return rounded(rounded(rows, "projected", "actual", "variance", "accuracy"), "spent", digits=3)


@query("forecast_daily_mean", "SELECT scope_id, target_month, day(forecast_date) % 5 AS day, round(sum(projected_amount) / any_value(n), 4) AS mean FROM forecast_history JOIN (SELECT scope_id, target_month, count(*) AS n FROM forecast_history GROUP BY 1, 2) USING (scope_id, target_month) GROUP BY 1, 2, 3")
def forecast_daily_mean(v):
    rows = v.forecast_history.select("scope_id", "target_month", F.create_map(F.dayofmonth("forecast_date") % 5, "projected_amount").alias("daily_forecasts"))
    return rounded(B.mean_daily_forecast(rows, ["scope_id", "target_month"]), "mean")


@query("forecast_quality_vectors", f"""
    WITH {CLUSTER_DAILY_SQL}, f AS (SELECT scope_id, forecast_date AS date, projected_amount AS predicted FROM forecast_history WHERE target_month = DATE '{START}'),
    j AS (SELECT coalesce(f.scope_id, c.scope_id) AS scope_id, coalesce(f.date, c.date) AS date, predicted, cost FROM f FULL JOIN (SELECT * FROM cluster_daily WHERE date >= DATE '{START}') c ON c.scope_id = f.scope_id AND c.date = f.date)
    SELECT scope_id, date, round(sum(coalesce(predicted, cost, 0)) OVER w, 4) AS forecast_cumulative, CASE WHEN date <= DATE '{CUTOFF}' THEN round(sum(coalesce(cost, 0)) OVER w, 4) END AS actual_cumulative FROM j WINDOW w AS (PARTITION BY scope_id ORDER BY date)""")
def forecast_quality_vectors(v):
    predicted = v.forecast_history.where(F.col("target_month") == F.lit(START)).select("scope_id", F.col("forecast_date").alias("date"), F.col("projected_amount").alias("predicted"))
    actual = cluster_daily(v).where(F.col("date") >= F.lit(START))
    return rounded(B.forecast_quality_vectors(predicted, actual, SCOPE, CUTOFF), "forecast_cumulative", "actual_cumulative")


ANOMALY_KEYS = ["scope_id", "anomaly_date", "anomaly_type"]


@query("anomaly_save", "WITH n AS (SELECT scope_id, anomaly_date, anomaly_type, actual_cost + 1 AS c FROM anomalies WHERE scope_id % 2 = 0) SELECT a.scope_id, a.anomaly_date, a.anomaly_type, round(coalesce(c, actual_cost), 4) AS actual_cost, round(threshold, 4) AS threshold, is_seen FROM anomalies a LEFT JOIN n ON n.scope_id = a.scope_id AND n.anomaly_date = a.anomaly_date AND n.anomaly_type = a.anomaly_type")
def anomaly_save(v):
    new = v.anomalies.where("scope_id % 2 = 0").withColumn("actual_cost", F.col("actual_cost") + 1).withColumn("is_seen", F.lit(False))
    return rounded(U.upsert(v.anomalies, new, ANOMALY_KEYS, {"actual_cost": "replace", "threshold": "replace", "is_seen": "keep"}), "actual_cost", "threshold")


@query("anomalies_for_month", f"SELECT scope_id, anomaly_date, arg_min(anomaly_type, k) AS anomaly_type, round(arg_min(actual_cost, k), 4) AS actual_cost, round(arg_min(threshold, k), 4) AS threshold, arg_min(is_seen, k) AS is_seen FROM (SELECT *, CASE WHEN anomaly_type = 'cost' THEN 0 ELSE 1 END AS k FROM anomalies) WHERE anomaly_date >= DATE '{START}' AND anomaly_date < DATE '{END}' GROUP BY 1, 2")
def anomalies_for_month(v):
    return rounded(B.anomalies_for_month(v.anomalies, SCOPE, START, END), "actual_cost", "threshold")


@query("anomalies_dashboard", f"SELECT scope_id, coalesce(e.name, concat('Scope ', scope_id)) AS scope_name, anomaly_date, anomaly_type, round(actual_cost, 4) AS actual_cost, round(threshold, 4) AS threshold, is_seen FROM anomalies LEFT JOIN entities e ON e.id = scope_id WHERE anomaly_date BETWEEN DATE '{START}' AND DATE '{END}' AND NOT is_seen")
def anomalies_dashboard(v):
    return rounded(B.anomalies_dashboard(v.anomalies, v.entities, START, END, only_unseen=True), "actual_cost", "threshold")


@query("anomaly_mark_seen", "SELECT scope_id, anomaly_date, anomaly_type, is_seen OR scope_id % 3 = 0 AS is_seen FROM anomalies")
def anomaly_mark_seen(v):
    seen = v.anomalies.where("scope_id % 3 = 0").select(*ANOMALY_KEYS, F.lit(True).alias("is_seen"))
    return U.upsert(v.anomalies, seen, ANOMALY_KEYS, {"is_seen": "replace"}).select(*ANOMALY_KEYS, "is_seen")


@query("anomaly_entry", "SELECT scope_id, anomaly_date, anomaly_type, actual_cost > threshold AND actual_cost > 250 AS is_anomaly, round(greatest(0, actual_cost - threshold), 4) AS delta FROM anomalies")
def anomaly_entry(v):
    e = v.anomalies.select(*ANOMALY_KEYS, B.anomaly_entry(F.col("actual_cost"), F.col("threshold"), 250.0).alias("e"))
    return rounded(e.select(*ANOMALY_KEYS, "e.is_anomaly", "e.delta"), "delta")


# metrics

STATS_SQL = "avg(value) AS avg_value, max(value) AS max_value, min(value) AS min_value, sum(value) AS sum_value, count(value) AS count_value"


def shown(df):
    """Rollups with their bucket as text and rounded statistics."""
    return rounded(df.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss")), "avg_value", "sum_value")


def shown_sql(inner: str, *keys: str) -> str:
    return f"SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, {', '.join(keys)}, round(avg_value, 4) AS avg_value, max_value, min_value, round(sum_value, 4) AS sum_value, count_value FROM ({inner})"


@query("metric_names", "SELECT DISTINCT entity_id, metric FROM metrics")
def metric_names(v):
    return v.metrics.select("entity_id", "metric").distinct()


@query("metric_has", "SELECT id, id IN (SELECT entity_id FROM metrics) AS has_metrics FROM entities")
def metric_has(v):
    have = v.metrics.select(F.col("entity_id").alias("id"), F.lit(True).alias("m")).distinct()
    return v.entities.select("id").join(have, "id", "left").select("id", F.coalesce("m", F.lit(False)).alias("has_metrics"))


@query("metric_series", shown_sql(f"SELECT entity_id, metric, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05') AS bucket, {STATS_SQL} FROM metrics WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2, 3", "entity_id", "metric"))
def metric_series(v):
    return shown(M.metric_series(v.metrics, dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 29), "1 week"))


@query("metric_source_pick", shown_sql(f"SELECT entity_id, metric, date_trunc('hour', ts) AS bucket, {STATS_SQL} FROM metrics GROUP BY 1, 2, 3", "entity_id", "metric"))
def metric_source_pick(v):
    tables = M.rollup_hierarchy(v.metrics)
    return shown(tables[M.metric_source_pick(6 * 3600).name]).select("bucket", "entity_id", "metric", "avg_value", "max_value", "min_value", "sum_value", "count_value")


HOURLY_SQL = f"SELECT entity_id, metric, date_trunc('hour', ts) AS bucket, {STATS_SQL} FROM metrics GROUP BY 1, 2, 3"


@query("telemetry_source_pick", f"SELECT entity_id, metric, round(max(max_value), 4) AS peak FROM ({HOURLY_SQL}) GROUP BY 1, 2")
def telemetry_source_pick(v):
    tables = M.rollup_hierarchy(v.metrics)
    return tables[M.telemetry_source_pick(30 * M.DAY).name].groupBy("entity_id", "metric").agg(F.round(F.max("max_value"), 4).alias("peak"))


@query("rollup_hourly", shown_sql(HOURLY_SQL, "entity_id", "metric"))
def rollup_hourly(v):
    return shown(M.rollup_first(v.metrics))


@query("rollup_daily", shown_sql(f"SELECT entity_id, metric, date_trunc('day', ts)::TIMESTAMP AS bucket, {STATS_SQL} FROM metrics GROUP BY 1, 2, 3", "entity_id", "metric"))
def rollup_daily(v):
    return shown(M.rollup_next(M.rollup_first(v.metrics)))


@query("rollup_hierarchy", f"SELECT 'metrics_hourly' AS level, count(*) AS buckets, round(sum(sum_value), 2) AS total FROM ({HOURLY_SQL}) UNION ALL SELECT 'metrics_daily', count(DISTINCT (entity_id, metric, ts::DATE)), round(sum(value), 2) FROM metrics")
def rollup_hierarchy(v):
    levels = M.rollup_hierarchy(v.metrics)
    parts = [df.agg(F.lit(name).alias("level"), F.count(F.lit(1)).alias("buckets"), F.round(F.sum("sum_value"), 2).alias("total")).select("level", "buckets", "total") for name, df in levels.items()]
    return parts[0].union(parts[1])


@query("promql_ns_requests", """
    WITH m AS (SELECT l_suppkey % 20 AS namespace, l_suppkey AS series, l_shipdate AS hour, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
    SELECT m.namespace, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(sum(v), 4) AS value, any_value(n_name) AS label FROM m LEFT JOIN nation ON n_nationkey = m.namespace AND n_nationkey < 10 GROUP BY 1, 2""")
def promql_ns_requests(v):
    samples = v.lineitem.select((F.col("l_suppkey") % 20).alias("namespace"), F.col("l_suppkey").alias("series"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("value"))
    labels = v.nation.where("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("namespace"), F.col("n_name").alias("label"))
    return rounded(M.namespace_requests(samples, labels).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss")), "value")


@query("retention_trim", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{METRICS_AS_OF - dt.timedelta(days=7)}'")
def retention_trim(v):
    return M.retention_trim(v.events, "ts", "metrics", METRICS_AS_OF).select("event_id")


EDGE = dt.datetime(2024, 1, 24, 12)


@query("retention_drop", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 3) AS total FROM metrics WHERE ts >= TIMESTAMP '{EDGE}' GROUP BY 1")
def retention_drop(v):
    """A stored table by day after its retention: older days gone as folders, the edge's day filtered."""
    path = S.work_folder(v.spark)
    v.metrics.withColumn("day", F.to_date("ts")).hint("rebalance", F.col("day")).write.partitionBy("day").parquet(path)
    Z.drop_before(v.spark, path, "day", "ts", EDGE)
    return v.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("metric_value_pick", "SELECT event_id, round(coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value * 2 END, CASE WHEN event_id % 5 = 0 THEN value * 3 END, 0), 4) AS value FROM events")
def metric_value_pick(v):
    def part(n: int, k: float):
        return F.when(F.col("event_id") % n == 0, F.col("value") * k)

    none = F.lit(None).cast("double")
    return v.events.select("event_id", F.round(N.first_value(part(2, 1.0), part(3, 2.0), part(5, 3.0), none, none), 4).alias("value"))


@query("metric_period_align", "SELECT event_id, CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS bucket, CASE event_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 60 WHEN 2 THEN 1440 ELSE 5 END AS minutes FROM events")
def metric_period_align(v):
    period = F.element_at(F.array(F.lit("PT5M"), F.lit("PT1H"), F.lit("P1D"), F.lit("weird")), (F.col("event_id") % 4 + 1).cast("int"))
    return v.events.select("event_id", F.unix_timestamp(align(F.col("ts").cast("timestamp"), 300)).alias("bucket"), iso_period_minutes(period).alias("minutes"))


@query("metric_rate_transform", "SELECT event_id, round(CASE event_type WHEN 'click' THEN value / 300 WHEN 'view' THEN value * 8 / 300 WHEN 'error' THEN 100 - value ELSE value END, 6) AS value FROM events")
def metric_rate_transform(v):
    name = F.when(F.col("event_type") == "click", "aws_ec2_disk_read_ops_avg").when(F.col("event_type") == "view", "azure_vm_net_in_avg").when(F.col("event_type") == "error", "azure_vm_mem_used_avg").otherwise("other_avg")
    return v.events.select("event_id", F.round(N.rate_transformed(name, F.col("value"), F.lit(300)), 6).alias("value"))


@query("metric_name_unify", "SELECT p_partkey, concat('cpu_', lower(p_type), '_avg') AS metric FROM part")
def metric_name_unify(v):
    return v.part.select("p_partkey", N.unified_metric(F.concat(F.lit("aws_ec2_CPU-"), "p_type", F.lit("_avg"))).alias("metric"))


# normalisation

OS_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'RHEL' WHEN 1 THEN 'SUSE' WHEN 2 THEN 'Windows' ELSE 'Linux' END"


@query("os_normalize", f"SELECT p_partkey, {OS_SQL} AS price_os, {OS_SQL} AS platform_os, {OS_SQL} AS image_os FROM part")
def os_normalize(v):
    k = (F.col("p_partkey") % 5 + 1).cast("int")

    def one(*names: str):
        return F.element_at(F.array(*[F.lit(n) for n in names]), k)

    price = one("Red Hat Enterprise", "SUSE Linux", "Virtual Machines Windows", "Virtual Machines", "Linux")
    details = one("Red Hat Enterprise Linux", "SUSE Linux", "Windows", "Linux/UNIX", "")
    publisher, offer, disk = one("RedHat", "x", "x", "x", "x"), one("x", "sles-15", "x", "x", "x"), one("Linux", "Linux", "Windows", "Linux", "")
    return v.part.select("p_partkey", N.os_of_price_name(price).alias("price_os"), N.os_of_platform(details, F.lit("")).alias("platform_os"), N.os_of_image(publisher, offer, disk).alias("image_os"))


@query("azure_arch_regex", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'arm64' ELSE 'x86_64' END AS architecture FROM part")
def azure_arch_regex(v):
    name = F.concat(F.lit("Standard_D"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "pds").otherwise("as"), F.lit("_v5"))
    return v.part.select("p_partkey", N.arch_of_size(name).alias("architecture"))


@query("vm_extras", "SELECT id, os AS normalized_os, coalesce(instance_type, 'unknown') AS instance_type FROM vms")
def vm_extras(v):
    e = v.vms.select("id", N.vm_extras(F.upper("os"), F.upper("instance_type")).alias("e"))
    return e.select("id", F.col("e")["normalized_os"].alias("normalized_os"), F.col("e")["instance_type"].alias("instance_type"))


@query("aws_tags_to_map", "SELECT id, coalesce(name, CAST(id AS STRING)) AS name, segment FROM entities WHERE type = 'vm'")
def aws_tags_to_map(v):
    pairs = F.array(F.struct(F.lit("Name").alias("Key"), F.col("name").alias("Value")), F.struct(F.lit("segment").alias("Key"), F.col("segment").alias("Value")))
    t = v.entities.where("type = 'vm'").select("id", N.key_value_tags(pairs).alias("t"))
    return t.select("id", F.coalesce(F.col("t")["Name"], F.col("id").cast("string")).alias("name"), F.col("t")["segment"].alias("segment"))


@query("meta_hash", "SELECT count(DISTINCT concat(coalesce(segment, '-'), '|', coalesce(tier, '-'), '|', coalesce(cluster, '-'), '|', coalesce(team, '-'))) AS n FROM entities")
def meta_hash(v):
    return v.entities.agg(F.count_distinct(N.meta_hash(tags_key(F.col("tags")))).alias("n"))


# billing exports

FOCUS_CUTOFF = dt.date(1996, 7, 24)
FOCUS_KEYS_SQL = "ProviderName, BillingAccountId, BillingAccountName, SubAccountId, SubAccountName, RegionId, coalesce(ResourceId, concat(SubAccountId, ':general')) AS resource_id, ServiceCategory, ServiceName, SkuPriceId, BillingCurrency, start_date"


def charges_sql(where: str) -> str:
    return f"SELECT {FOCUS_KEYS_SQL}, max(end_date) AS end_date, sum(EffectiveCost) AS billed_cost FROM focus_raw WHERE EffectiveCost <> 0 AND ChargeCategory <> 'Credit' AND {where} GROUP BY ALL"


DAILY_CHARGES_SQL = charges_sql(f"start_date >= DATE '{FOCUS_CUTOFF}' AND end_date - start_date <= 1")
MULTI_SQL = charges_sql(f"end_date > DATE '{FOCUS_CUTOFF}' AND end_date - start_date > 1")
SPREAD_SQL = f"SELECT * EXCLUDE (start_date, end_date, billed_cost), billed_cost / n AS billed_cost, start_date + CAST(k AS INT) AS start_date FROM (SELECT *, least(end_date, DATE '{AS_OF}') - start_date AS n, unnest(range(greatest(least(end_date, DATE '{AS_OF}') - start_date, 0))) AS k FROM ({MULTI_SQL}))"
CHARGE_COLUMNS = ["resource_id", "SubAccountId", "ServiceCategory", "SkuPriceId", "start_date", "end_date", "billed_cost"]


@query("focus_scan", "SELECT CASE WHEN ProviderName LIKE 'Amazon%' THEN 'aws' WHEN ProviderName LIKE 'Micro%' THEN 'azure' ELSE 'unknown' END AS provider, count(*) AS n, round(sum(EffectiveCost), 2) AS cost, min(start_date) AS first FROM focus_raw GROUP BY 1")
def focus_scan(v):
    path = S.work_folder(v.spark)
    raw = v.focus_raw.select("*", F.col("start_date").alias("ChargePeriodStart"), F.col("end_date").alias("ChargePeriodEnd")).drop("start_date", "end_date")
    raw.write.option("header", True).option("compression", "gzip").csv(path)
    rows = X.with_dates(X.focus_scan(v.spark, path))
    return rows.groupBy(N.provider_of(F.col("ProviderName")).alias("provider")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("EffectiveCost"), 2).alias("cost"), F.min("start_date").alias("first"))


@query("focus_stream", "SELECT CASE WHEN ProviderName LIKE 'Amazon%' THEN 'aws' WHEN ProviderName LIKE 'Micro%' THEN 'azure' ELSE 'unknown' END AS provider, count(*) AS n, round(sum(EffectiveCost), 2) AS cost, min(start_date) AS first FROM focus_raw GROUP BY 1")
def focus_stream(v):
    """Two exports that manifests name as they arrive; the second has its columns otherwise and one more, and its manifest names the first one's files again."""
    folder = S.work_folder(v.spark)
    raw = v.focus_raw.select("*", F.col("start_date").alias("ChargePeriodStart"), F.col("end_date").alias("ChargePeriodEnd")).drop("start_date", "end_date")
    shape = "export string, run long, completed timestamp, files array<string>"
    parts = [raw.where("ProviderName LIKE 'Amazon%'"), raw.where("ProviderName NOT LIKE 'Amazon%'").withColumn("New", F.lit("x")).select("New", *reversed(raw.columns))]
    for k, part in enumerate(parts):
        part.write.option("header", True).option("compression", "gzip").csv(f"{folder}/export{k}")
        files = [f"{folder}/export{i}" for i in range(k + 1)]
        v.spark.createDataFrame([("e", k, dt.datetime(2024, 1, 1 + k), files), ("e", 9, None, ["nowhere"])], shape).coalesce(1).write.mode("append").json(f"{folder}/manifests")
        X.export_stream(v.spark.readStream.schema(shape).json(f"{folder}/manifests"), f"{folder}/out").awaitTermination()
    rows = X.with_dates(v.spark.read.parquet(f"{folder}/out/rows"))
    return rows.groupBy(N.provider_of(F.col("ProviderName")).alias("provider")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("EffectiveCost"), 2).alias("cost"), F.min("start_date").alias("first"))


@query("focus_daily_charges", f"SELECT {', '.join(CHARGE_COLUMNS[:-1])}, round(billed_cost, 4) AS billed_cost FROM ({DAILY_CHARGES_SQL})")
def focus_daily_charges(v):
    return rounded(X.focus_daily_charges(v.focus_raw, FOCUS_CUTOFF).select(*CHARGE_COLUMNS), "billed_cost")


@query("focus_multiday_charges", f"SELECT {', '.join(CHARGE_COLUMNS[:-1])}, round(billed_cost, 4) AS billed_cost FROM ({MULTI_SQL})")
def focus_multiday_charges(v):
    return rounded(X.focus_multiday_charges(v.focus_raw, FOCUS_CUTOFF).select(*CHARGE_COLUMNS), "billed_cost")


@query("spread_multiday", f"SELECT resource_id, SubAccountId, ServiceCategory, SkuPriceId, start_date, round(billed_cost, 4) AS billed_cost FROM ({SPREAD_SQL})")
def spread_multiday(v):
    rows = X.spread_multiday(X.focus_multiday_charges(v.focus_raw, FOCUS_CUTOFF), AS_OF)
    return rounded(rows.select("resource_id", "SubAccountId", "ServiceCategory", "SkuPriceId", "start_date", "billed_cost"), "billed_cost")


@query("focus_normalize", f"SELECT CASE WHEN ProviderName LIKE 'Amazon%' THEN 'aws' WHEN ProviderName LIKE 'Micro%' THEN 'azure' ELSE 'unknown' END AS provider, split_part(SubAccountId, '/', -1) AS account_id, resource_id, service_category, start_date AS charge_start, round(billed_cost, 4) AS billed_cost FROM (SELECT *, ServiceCategory AS service_category FROM ({DAILY_CHARGES_SQL}))")
def focus_normalize(v):
    rows = X.focus_normalize(X.focus_daily_charges(v.focus_raw, FOCUS_CUTOFF))
    return rounded(rows.select("provider", "account_id", "resource_id", "service_category", "charge_start", "billed_cost"), "billed_cost")


@query("costs_from_export", f"SELECT charge_start, count(*) AS n, round(sum(billed_cost), 3) AS cost FROM (SELECT start_date AS charge_start, billed_cost FROM ({DAILY_CHARGES_SQL}) UNION ALL SELECT start_date, billed_cost FROM ({SPREAD_SQL})) GROUP BY 1")
def costs_from_export(v):
    return X.costs_from_export(v.focus_raw, AS_OF).groupBy("charge_start").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("billed_cost"), 3).alias("cost"))


@query("export_latest_manifest", """
    WITH m AS (SELECT o_custkey % 50 AS export, o_orderkey AS run, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS completed FROM orders), d AS (SELECT export, max(completed) AS day FROM m GROUP BY 1)
    SELECT export, run, concat('f', run) AS file FROM (SELECT m.*, row_number() OVER (PARTITION BY export ORDER BY completed DESC, run DESC) AS k FROM m JOIN d USING (export) WHERE completed = day) WHERE k <= 2""")
def export_latest_manifest(v):
    m = v.orders.select((F.col("o_custkey") % 50).alias("export"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("completed"), F.array(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))).alias("files"))
    return X.export_latest_manifest(m)


# payloads: the given rows as JSON, flattened again


#: Rows of a payload, about; the slices of a table grow with its rows.
PAYLOAD_ROWS = 2000


def sliced(df, key: str, rows: int | None = None):
    """``df`` with a hash slice of about ``rows`` rows, which grouping into payloads takes as one more key."""
    n = max(1, -(-df.count() // (rows or PAYLOAD_ROWS)))
    return df.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(n)))


def point(names: dict):
    return F.struct(*[c.alias(n) for n, c in names.items()])


POINT_SQL = "SELECT CAST(user_id AS STRING) AS resource_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, round(value, 4) AS value FROM events"


@query("azure_metric_points", POINT_SQL)
def azure_metric_points(v):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    per = sliced(v.events, "event_id").groupBy("user_id", "slice").agg(F.collect_list(point({"time_stamp": stamp, "average": F.when(F.col("event_id") % 2 == 0, F.col("value")), "maximum": F.when(F.col("event_id") % 2 == 1, F.col("value"))})).alias("data"))
    inner = F.struct(F.array(F.struct(F.array(F.struct("data")).alias("timeseries"))).alias("value"))
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.create_map(F.lit("cpu"), F.struct(inner.alias("metrics_data"))).alias("c7n:metrics")))
    rows = P.azure_metric_points(per.select(body.alias("payload")))
    return rows.select("resource_id", F.unix_timestamp("ts").alias("ts"), F.round("value", 4).alias("value"))


@query("aws_metric_points", POINT_SQL)
def aws_metric_points(v):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    per = sliced(v.events, "event_id").groupBy("user_id", "slice").agg(F.collect_list(point({"Timestamp": stamp, "Sum": F.col("value")})).alias("data"))
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("InstanceId"), F.create_map(F.lit("cpu"), F.col("data")).alias("c7n.metrics")))
    rows = P.aws_metric_points(per.select(body.alias("payload")))
    return rows.select("resource_id", F.unix_timestamp("ts").alias("ts"), F.round("value", 4).alias("value"))


@query("prom_matrix_points", "SELECT concat('c', event_type, ':namespace/ns', user_id % 10) AS urn, event_type AS app, CAST(floor(epoch(ts)) AS BIGINT) AS ts, round(value, 4) AS value FROM events WHERE user_id % 10 <> 3")
def prom_matrix_points(v):
    e = sliced(v.events, "event_id").select("event_type", "slice", (F.col("user_id") % 10).alias("k"), F.array(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.col("value").cast("string")).alias("v"))
    series = e.groupBy("event_type", "slice", "k").agg(F.collect_list("v").alias("values"))
    names = F.map_filter(F.create_map(F.lit("namespace"), F.when(F.col("k") != 3, F.concat(F.lit("ns"), F.col("k").cast("string"))), F.lit("label_app"), F.col("event_type")), lambda k, x: x.isNotNull())
    per = series.groupBy("event_type", "slice").agg(F.collect_list(F.struct(names.alias("metric"), "values")).alias("result"))
    rows = P.prom_matrix_points(per.select(F.concat(F.lit("c"), "event_type").alias("cluster"), F.to_json(F.struct(F.struct("result").alias("data"))).alias("payload")))
    return rows.select("urn", F.col("tags")["app"].alias("app"), F.unix_timestamp("ts").alias("ts"), F.round("value", 4).alias("value"))


@query("prom_matrix_rejects", """
    WITH c AS (SELECT o_custkey AS k, count(*) AS series, count(*) FILTER (o_orderstatus = 'P') AS nameless, count(*) FILTER (o_orderstatus <> 'P' AND o_orderkey % 5 = 0) AS empty FROM orders GROUP BY 1)
    SELECT reason, count(*) AS payloads, sum(n)::BIGINT AS n FROM (SELECT 'no JSON' AS reason, 1 AS n FROM c WHERE k % 7 = 0 UNION ALL SELECT 'no result', 1 FROM c WHERE k % 7 = 1
      UNION ALL SELECT 'no namespace', nameless FROM c WHERE k % 7 > 1 AND nameless > 0 UNION ALL SELECT 'no values', empty FROM c WHERE k % 7 > 1 AND empty > 0) GROUP BY 1""")
def prom_matrix_rejects(v):
    """Why payloads and series can't be read, over payloads of customers' orders of which some are broken."""
    names = F.map_filter(F.create_map(F.lit("namespace"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.lit("n"), F.col("o_orderkey").cast("string")), lambda k, x: x.isNotNull())
    none = F.array().cast("array<array<string>>")
    values = F.when(F.col("o_orderkey") % 5 == 0, none).otherwise(F.array(F.array(F.lit("1"), F.col("o_totalprice").cast("string"))))
    per = v.orders.groupBy("o_custkey").agg(F.collect_list(F.struct(names.alias("metric"), values.alias("values"))).alias("result"))
    whole = F.to_json(F.struct(F.struct("result").alias("data")))
    body = F.when(F.col("o_custkey") % 7 == 0, F.substring(whole, 1, 20)).when(F.col("o_custkey") % 7 == 1, F.lit('{"data": {"result": "none"}}')).otherwise(whole)
    rows = P.prom_matrix_rejects(per.select(F.col("o_custkey").cast("string").alias("cluster"), body.alias("payload")))
    per_payload = rows.groupBy("cluster", "reason").agg(F.count(F.lit(1)).alias("m"))
    return per_payload.groupBy("reason").agg(F.count(F.lit(1)).alias("payloads"), F.sum("m").alias("n"))


@query("krr_scan_rows", "SELECT concat('c', s_nationkey, ':namespace/', s_name) AS urn, 'Deployment' AS workload_type, concat('w', s_suppkey) AS workload, '250m' AS cpu_now, CAST(CAST(s_suppkey AS INT) AS STRING) AS cpu_wanted FROM supplier WHERE s_suppkey % 7 <> 0")
def krr_scan_rows(v):
    key = F.col("s_suppkey").cast("int").cast("string")
    obj = F.struct(F.col("s_name").alias("namespace"), F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("w"), key)).alias("name"), F.lit("Deployment").alias("kind"), F.lit("main").alias("container"), F.struct(F.create_map(F.lit("cpu"), F.lit("250m")).alias("requests")).alias("allocations"))
    wanted = F.struct(F.create_map(F.lit("cpu"), F.struct(key.alias("value"))).alias("requests"))
    per = sliced(v.supplier, "s_suppkey").groupBy("s_nationkey", "slice").agg(F.collect_list(F.struct(obj.alias("object"), wanted.alias("recommended"))).alias("scans"))
    rows = P.krr_scan_rows(per.select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("cluster"), F.to_json(F.struct("scans")).alias("payload")))
    return rows.select("urn", "workload_type", "workload", "cpu_now", "cpu_wanted")


@query("azure_sku_hardware", "SELECT concat('Standard_D', p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'ps' ELSE 's' END, '_v5') AS instance_type, p_size AS vcpu, p_size * 4.0 AS memory_gb, CASE WHEN p_partkey % 4 = 0 THEN 'arm64' ELSE 'x86_64' END AS architecture, p_partkey % 11 = 0 AS is_gpu, p_partkey % 3 = 0 AS supports_premium FROM part WHERE p_partkey % 5 <> 0")
def azure_sku_hardware(v):
    def cap(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    k = F.col("p_partkey")
    caps = F.array(cap("vCPUs", F.col("p_size")), cap("MemoryGB", F.col("p_size") * 4), cap("GPUs", F.when(k % 11 == 0, 1).otherwise(0)), cap("PremiumIO", F.when(k % 3 == 0, "True").otherwise("False")))
    name = F.concat(F.lit("Standard_D"), k.cast("string"), F.when(k % 4 == 0, "ps").otherwise("s"), F.lit("_v5"))
    sku = F.struct(F.when(k % 5 == 0, "disks").otherwise("virtualMachines").alias("resourceType"), name.alias("name"), F.lit("standardDSFamily").alias("family"), caps.alias("capabilities"))
    per = sliced(v.part, "p_partkey").groupBy((k % 16).alias("g"), "slice").agg(F.collect_list(sku).alias("value"))
    return P.azure_sku_hardware(per.select(F.to_json(F.struct("value")).alias("payload"))).select("instance_type", "vcpu", "memory_gb", "architecture", "is_gpu", "supports_premium")


@query("aws_type_hardware", "SELECT concat('t', p_partkey, '.large') AS instance_type, p_size AS vcpu, p_size * 0.5 AS memory_gb, p_size * 1000.0 AS network_mbps, CASE WHEN p_partkey % 4 = 0 THEN 'arm64' ELSE 'x86_64' END AS architecture, p_partkey % 11 = 0 AS is_gpu, p_partkey % 3 = 0 AS has_local_storage FROM part")
def aws_type_hardware(v):
    k = F.col("p_partkey")
    kind = F.struct(
        F.concat(F.lit("T"), k.cast("string"), F.lit(".large")).alias("InstanceType"), F.struct(F.col("p_size").alias("DefaultVCpus")).alias("VCpuInfo"), F.struct((F.col("p_size") * 512).alias("SizeInMiB")).alias("MemoryInfo"),
        F.struct(F.concat(F.lit("Up to "), F.col("p_size").cast("string"), F.lit(" Gigabit")).alias("NetworkPerformance")).alias("NetworkInfo"), F.struct(F.array(F.when(k % 4 == 0, "arm64").otherwise("x86_64")).alias("SupportedArchitectures")).alias("ProcessorInfo"),
        F.when(k % 11 == 0, F.struct(F.array(F.struct(F.lit("g").alias("Name"))).alias("Gpus"))).alias("GpuInfo"), (k % 3 == 0).alias("InstanceStorageSupported"),
    )
    per = sliced(v.part, "p_partkey").groupBy((k % 16).alias("g"), "slice").agg(F.collect_list(kind).alias("InstanceTypes"))
    return P.aws_type_hardware(per.select(F.to_json(F.struct("InstanceTypes")).alias("payload"))).select("instance_type", "vcpu", "memory_gb", "network_mbps", "architecture", "is_gpu", "has_local_storage")


@query("azure_price_rows", "SELECT concat('t', p_partkey) AS instance_type, CASE WHEN p_partkey % 2 = 0 THEN 'windows' ELSE 'linux' END AS os, p_retailprice AS hourly_price FROM part WHERE p_partkey % 4 <> 0")
def azure_price_rows(v):
    k = F.col("p_partkey")
    meter = F.element_at(F.array(F.lit("D2 Spot"), F.lit("D2"), F.lit("D4"), F.lit("D8")), (k % 4 + 1).cast("int"))
    item = F.struct(meter.alias("meterName"), F.when(k % 2 == 0, "VM Windows").otherwise("VM").alias("productName"), F.concat(F.lit("T"), k.cast("string")).alias("armSkuName"), F.lit("r").alias("armRegionName"), F.col("p_retailprice").alias("retailPrice"))
    per = sliced(v.part, "p_partkey").groupBy((k % 16).alias("g"), "slice").agg(F.collect_list(item).alias("Items"))
    return P.azure_price_rows(per.select(F.to_json(F.struct("Items")).alias("payload"))).select("instance_type", "os", "hourly_price")


@query("aws_price_rows", "SELECT concat('t', p_partkey) AS instance_type, concat('g', p_partkey % 16) AS region, CASE WHEN p_partkey % 3 = 0 THEN 'windows' ELSE 'linux' END AS os, p_retailprice AS hourly_price FROM part WHERE p_partkey % 5 <> 0")
def aws_price_rows(v):
    k = F.col("p_partkey")
    sku = k.cast("string")
    attributes = F.create_map(*[x for n, c in (("tenancy", F.when(k % 5 == 0, "Dedicated").otherwise("Shared")), ("capacitystatus", F.lit("Used")), ("preInstalledSw", F.lit("NA")), ("instanceType", F.concat(F.lit("T"), sku)), ("operatingSystem", F.when(k % 3 == 0, "Windows").otherwise("Linux"))) for x in (F.lit(n), c)])
    product = F.struct(sku, F.struct(F.lit("Compute Instance").alias("productFamily"), attributes.alias("attributes")))
    term = F.struct(sku, F.create_map(F.lit("o"), F.struct(F.create_map(F.lit("c"), F.struct(F.create_map(F.lit("USD"), F.col("p_retailprice").cast("string")).alias("pricePerUnit"))).alias("priceDimensions"))))
    per = sliced(v.part, "p_partkey").groupBy((k % 16).alias("g"), "slice").agg(F.map_from_entries(F.collect_list(product)).alias("products"), F.map_from_entries(F.collect_list(term)).alias("OnDemand"))
    rows = P.aws_price_rows(per.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("region"), F.to_json(F.struct("products", F.struct("OnDemand").alias("terms"))).alias("payload")))
    return rows.select("instance_type", "region", "os", "hourly_price")


# rightsizing

TELEMETRY = {"cpu_p95": "click", "ram_max": "view", "disk_read_max": "error", "disk_write_max": "purchase", "net_in_max": "signup", "net_out_max": "signup"}
TELEMETRY_SQL = ", ".join(f"quantile_cont(value, 0.95) FILTER (metric = '{m}') AS {c}" if c == "cpu_p95" else f"max(value) FILTER (metric = '{m}') AS {c}" for c, m in TELEMETRY.items())
META_SQL = "SELECT v.*, h.vcpu, h.memory_gb, architecture, is_gpu, is_confidential, has_local_storage, supports_premium FROM vms v LEFT JOIN hardware h ON h.instance_type = v.instance_type"
NEEDS_SQL = f"""meta AS ({META_SQL}), tel AS (SELECT entity_id, {TELEMETRY_SQL} FROM metrics GROUP BY 1),
  needs AS (SELECT meta.*, tel.* EXCLUDE (entity_id), greatest(1.0, coalesce(vcpu * cpu_p95 / 85.0, vcpu::DOUBLE)) AS need_vcpu, greatest(1.0, coalesce(memory_gb * ram_max / 80.0, memory_gb)) AS need_ram, coalesce(disk_read_max, 0) + coalesce(disk_write_max, 0) AS need_iops,
    CASE WHEN provider = 'azure' THEN coalesce(net_out_max, 0) / 1e6 ELSE greatest(coalesce(net_in_max, 0), coalesce(net_out_max, 0)) / 1e6 END AS need_net FROM meta LEFT JOIN tel ON tel.entity_id = meta.id)"""
IDLE_SQL = "(coalesce(cpu_p95, ram_max, disk_read_max, disk_write_max, net_in_max, net_out_max) IS NOT NULL AND coalesce(cpu_p95 < 5, true) AND coalesce(ram_max < 5, true) AND coalesce(disk_read_max < 50, true) AND coalesce(disk_write_max < 50, true) AND coalesce(net_in_max < 5e6, true) AND coalesce(net_out_max < 5e6, true))"
WARN_SQL = "concat_ws('|', CASE WHEN h.architecture <> n.architecture THEN 'architecture' END, CASE WHEN n.is_confidential AND NOT h.is_confidential THEN 'confidential' END, CASE WHEN n.has_local_storage AND NOT h.has_local_storage THEN 'local storage' END, CASE WHEN n.supports_premium AND NOT h.supports_premium THEN 'premium storage' END)"
CANDIDATES_SQL = f"""cand AS (SELECT n.id, h.instance_type AS candidate, p.hourly_price AS candidate_price, {WARN_SQL} AS warnings FROM needs n JOIN pricing p ON p.cloud = n.provider AND p.region = n.region AND p.os = n.os AND p.hourly_price > 0 JOIN hardware h ON h.cloud = p.cloud AND h.instance_type = p.instance_type
    WHERE h.vcpu >= need_vcpu AND h.memory_gb >= need_ram AND (h.baseline_iops IS NULL OR h.baseline_iops >= need_iops) AND (h.throughput IS NULL OR h.throughput >= need_net) AND h.is_gpu = n.is_gpu AND h.instance_type NOT LIKE 't9%')"""


def vm_needs(v):
    meta = R.vm_metadata(v.vms, v.hardware)
    tel = R.vm_telemetry(v.metrics, TELEMETRY).withColumnRenamed("entity_id", "id")
    return R.vm_requirements(meta.join(tel, "id", "left"))


@query("vm_metadata", f"SELECT id, instance_type, vcpu, memory_gb, architecture, is_gpu FROM ({META_SQL})")
def vm_metadata(v):
    return R.vm_metadata(v.vms, v.hardware).select("id", "instance_type", "vcpu", "memory_gb", "architecture", "is_gpu")


@query("vm_telemetry", f"SELECT entity_id, {', '.join(f'round({c}, 4) AS {c}' for c in TELEMETRY)} FROM (SELECT entity_id, {TELEMETRY_SQL} FROM metrics GROUP BY 1)")
def vm_telemetry(v):
    return rounded(R.vm_telemetry(v.metrics, TELEMETRY), *TELEMETRY)


VM_COST_SQL = f"SELECT entity_id AS id, sum(billed_cost * CASE WHEN currency = 'USD' THEN {RATE} ELSE 1.0 END) / 31 AS daily_cost FROM costs WHERE charge_date >= DATE '{START}' AND charge_date < DATE '{END}' GROUP BY 1"


def vm_cost(v):
    days = (END - START).days
    return C.entity_daily(v.costs, START, END, RATE).groupBy(F.col("entity_id").alias("id")).agg((F.sum("cost") / days).alias("daily_cost"))


@query("vm_daily_cost", f"SELECT id, round(daily_cost, 4) AS daily_cost FROM ({VM_COST_SQL})")
def vm_daily_cost(v):
    return rounded(vm_cost(v), "daily_cost")


@query("vm_catalog_price", "SELECT id, round(hourly_price, 6) AS hourly_price FROM vms v LEFT JOIN pricing p ON p.cloud = v.provider AND p.region = v.region AND p.os = v.os AND p.instance_type = v.instance_type")
def vm_catalog_price(v):
    price = v.pricing.withColumnRenamed("cloud", "provider")
    return rounded(v.vms.join(price, ["provider", "region", "os", "instance_type"], "left").select("id", "hourly_price"), "hourly_price", digits=6)


@query("vm_requirements", f"WITH {NEEDS_SQL} SELECT id, round(need_vcpu, 4) AS need_vcpu, round(need_ram, 4) AS need_ram, round(need_iops, 4) AS need_iops, round(need_net, 6) AS need_net FROM needs")
def vm_requirements(v):
    return rounded(rounded(vm_needs(v).select("id", "need_vcpu", "need_ram", "need_iops", "need_net"), "need_vcpu", "need_ram", "need_iops"), "need_net", digits=6)


@query("vm_idle", f"WITH {NEEDS_SQL} SELECT id, {IDLE_SQL} AS idle FROM needs")
def vm_idle(v):
    return vm_needs(v).select("id", R.vm_idle().alias("idle"))


@query("vm_candidates", f"WITH {NEEDS_SQL}, {CANDIDATES_SQL} SELECT id, candidate, round(candidate_price, 6) AS candidate_price, warnings FROM cand")
def vm_candidates(v):
    """Every type that meets a machine's needs; prices are rounded on the offers, as fits don't depend on them."""
    offers = rounded(R.offers_of(v.hardware, v.pricing, F.array(F.lit("t9*"))), "candidate_price", digits=6)
    return R.listed_fits(vm_needs(v), offers, lambda mask: F.array_join(R.warnings_of(mask), "|"))


@query("vm_candidate_warnings", f"WITH {NEEDS_SQL}, {CANDIDATES_SQL} SELECT warnings, count(*) AS n FROM cand GROUP BY 1")
def vm_candidate_warnings(v):
    """How often each set of warnings occurs among all fits."""
    return R.warning_counts(vm_needs(v), v.hardware, v.pricing, F.array(F.lit("t9*"))).select(F.array_join("warnings", "|").alias("warnings"), "n")


@query("vm_rightsize", f"""
    WITH {NEEDS_SQL}, {CANDIDATES_SQL}, vm AS (SELECT n.id, n.instance_type, {IDLE_SQL} AS idle, p.hourly_price AS price, coalesce(daily_cost, 0) AS daily_cost FROM needs n LEFT JOIN pricing p ON p.cloud = n.provider AND p.region = n.region AND p.os = n.os AND p.instance_type = n.instance_type LEFT JOIN ({VM_COST_SQL}) c USING (id)),
    first AS (SELECT cand.*, vm.price, vm.daily_cost, row_number() OVER (PARTITION BY cand.id, warnings ORDER BY candidate_price, candidate) AS k FROM cand JOIN vm USING (id) WHERE price IS NULL OR candidate_price < price),
    clean AS (SELECT *, coalesce(sum(CASE WHEN warnings = '' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY candidate_price, candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM first WHERE k = 1),
    rec AS (SELECT id, 'success' AS status, 'downsize_recommended' AS action, row_number() OVER (PARTITION BY id ORDER BY candidate_price, candidate) AS position, candidate AS recommended, warnings, CASE WHEN price > 0 THEN daily_cost * (1 - (price - candidate_price) / price) END AS projected, CASE WHEN price > 0 THEN daily_cost * (price - candidate_price) / price * 30 END AS savings, CASE WHEN price > 0 THEN (price - candidate_price) / price * 100 END AS percent FROM clean WHERE c = 0
      UNION ALL SELECT id, 'success', 'downsize_recommended', 0, 'shutdown', 'idle', CASE WHEN price > 0 THEN 0.0 END, CASE WHEN price > 0 THEN daily_cost * 30 END, CASE WHEN price > 0 THEN 100.0 END FROM vm WHERE idle AND instance_type IS NOT NULL)
    SELECT id, status, action, CAST(position AS INT) AS position, recommended, warnings, round(projected, 4) AS projected_daily_cost, round(savings, 4) AS monthly_savings, round(percent, 4) AS savings_percent FROM rec
    UNION ALL SELECT id, CASE WHEN instance_type IS NULL THEN 'unsupported' ELSE 'success' END, 'none', NULL, NULL, NULL, NULL, NULL, NULL FROM vm WHERE id NOT IN (SELECT id FROM rec)""")
def vm_rightsize(v):
    return rounded(R.vm_rightsize(vm_needs(v), v.hardware, v.pricing, vm_cost(v), F.array(F.lit("t9*"))), "projected_daily_cost", "monthly_savings", "savings_percent")


EXCLUSIONS = [(0, {}, ["t1*"]), (1, {"segment": "BUILDING"}, ["t2*", "t3*"]), (2, {"tier": "gold"}, ["t4*"]), (103, {"segment": "BUILDING", "tier": "gold"}, ["t5*"])]


def exclusions(v):
    return v.spark.createDataFrame(EXCLUSIONS, "scope_id long, tags map<string,string>, patterns array<string>")


@query("exclusion_exact", "SELECT id, CASE WHEN segment = 'BUILDING' AND tier = 'gold' THEN 't5*' END AS patterns FROM entities WHERE segment = 'BUILDING' AND tier = 'gold' AND parent_id = 103 UNION ALL SELECT id, 't1*' FROM entities WHERE parent_id = 0 AND coalesce(segment, tier, cluster, team) IS NULL")
def exclusion_exact(v):
    wanted = v.entities.select("id", F.col("parent_id").alias("scope_id"), "tags")
    keyed = wanted.select("id", "scope_id", tags_key(F.col("tags")).alias("tags_key"))
    return R.exclusion_exact(exclusions(v), wanted.select("scope_id", "tags")).distinct().join(keyed, ["scope_id", "tags_key"]).select("id", F.array_join("patterns", ",").alias("patterns"))


@query("exclusion_for_entity", "SELECT id, concat_ws(',', 't1*', CASE WHEN segment = 'BUILDING' THEN 't2*,t3*' END, CASE WHEN tier = 'gold' THEN 't4*' END, CASE WHEN segment = 'BUILDING' AND tier = 'gold' THEN 't5*' END) AS patterns FROM entities")
def exclusion_for_entity(v):
    return R.exclusion_for_entity(exclusions(v), v.entities).select("id", F.array_join("patterns", ",").alias("patterns"))


@query("exclusion_set", "SELECT parent_id AS scope_id, segment, CASE WHEN segment = 'BUILDING' THEN 'new' ELSE 'old' END AS pattern, count(*) AS n FROM entities WHERE segment IS NOT NULL GROUP BY 1, 2, 3")
def exclusion_set(v):
    own = v.entities.where("segment IS NOT NULL").groupBy(F.col("parent_id").alias("scope_id"), "segment").agg(F.count(F.lit(1)).alias("n"))
    target = own.withColumn("pattern", F.lit("old"))
    return U.upsert(target, own.where("segment = 'BUILDING'").select("scope_id", "segment", F.lit("new").alias("pattern")), ["scope_id", "segment"], {"pattern": "replace"})


@query("tag_filter_rules", "SELECT id, segment LIKE 'BUILD%' OR segment LIKE '%HOLD' AS hidden FROM entities WHERE segment IS NOT NULL")
def tag_filter_rules(v):
    from costloom.functions.tags import glob_to_regex

    hidden = F.lit(False)
    for p in ("BUILD*", "*HOLD"):
        hidden = hidden | F.rlike("segment", glob_to_regex(F.lit(p)))
    return v.entities.where("segment IS NOT NULL").select("id", hidden.alias("hidden"))


@query("tag_filter_edit", "SELECT c_custkey AS rule_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(lower(c_mktsegment), ':*') END AS pattern FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey % 3 = 0 ORDER BY 1 DESC")
def tag_filter_edit(v):
    """Rules of customers with orders are deleted; then every third rule is added again."""
    patterns = F.when(F.col("c_custkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lower("c_mktsegment"), F.lit(":*")), F.lit("unused")))
    rules = v.customer.select(F.col("c_custkey").alias("rule_id"), patterns.alias("patterns"))
    left = C.delete_rules(rules, v.orders.select(F.col("o_custkey").alias("rule_id")))
    return C.tag_filters(U.upsert(left, rules.where("rule_id % 3 = 0"), ["rule_id"], {}))


KRR_SQL = "SELECT e.parent_id AS cluster_id, max(scanned) AS latest FROM recommendations r JOIN entities e ON e.id = r.entity_id GROUP BY 1"


@query("krr_clusters", f"SELECT cluster_id, name AS cluster, latest FROM ({KRR_SQL}) JOIN entities ON id = cluster_id")
def krr_clusters(v):
    return R.krr_clusters(v.recommendations, v.entities)


@query("krr_latest", f"SELECT cluster_id, e.name AS namespace, workload_type, workload, container, r.scanned FROM recommendations r JOIN entities e ON e.id = r.entity_id JOIN ({KRR_SQL}) ON cluster_id = e.parent_id AND latest = scanned")
def krr_latest(v):
    return R.krr_latest(v.recommendations, v.entities).select("cluster_id", "namespace", "workload_type", "workload", "container", "scanned")


@query("humanize_cpu", "SELECT DISTINCT cpu, CASE WHEN cpu IS NULL OR cpu = 'None' THEN '-' WHEN TRY_CAST(cpu AS DOUBLE) IS NULL THEN cpu WHEN cpu::DOUBLE < 1 THEN concat(printf('%.0f', cpu::DOUBLE * 1000), 'm') ELSE printf('%.2f', cpu::DOUBLE) END AS shown FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'None' WHEN l_linenumber = 5 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS cpu FROM lineitem)")
def humanize_cpu(v):
    n = F.col("l_linenumber")
    cpu = F.when(n == 7, None).when(n == 6, "None").when(n == 5, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return v.lineitem.select(cpu.alias("cpu")).distinct().select("cpu", N.humanize_cpu(F.col("cpu")).alias("shown"))


@query("humanize_memory", "SELECT DISTINCT memory, CASE WHEN memory IS NULL THEN '-' WHEN memory::DOUBLE >= 1073741824 THEN concat(printf('%.2f', memory::DOUBLE / 1073741824), ' Gi') WHEN memory::DOUBLE >= 1048576 THEN concat(printf('%.0f', memory::DOUBLE / 1048576), ' Mi') WHEN memory::DOUBLE >= 1024 THEN concat(printf('%.0f', memory::DOUBLE / 1024), ' Ki') ELSE concat(printf('%.0f', memory::DOUBLE), ' B') END AS shown FROM recommendations")
def humanize_memory(v):
    return v.recommendations.select("memory").distinct().select("memory", N.humanize_memory(F.col("memory")).alias("shown"))


# upserts

HALF_SQL = "SELECT entity_id, charge_date, service, sku, max(billed_cost) AS billed_cost FROM costs GROUP BY ALL"


@query("costs_upsert", f"WITH old AS ({HALF_SQL}) SELECT entity_id, charge_date, lower(service) AS service, sku, round(CASE WHEN sku % 2 = 0 THEN billed_cost * 3 ELSE billed_cost END, 4) AS billed_cost FROM old")
def costs_upsert(v):
    keys = ["entity_id", "charge_date", "service", "sku"]
    raw = v.costs.groupBy(*keys).agg(F.max("billed_cost").alias("billed_cost"))
    new = raw.where("sku % 2 = 0").withColumn("billed_cost", F.col("billed_cost") * 3)
    return rounded(U.upsert(U.lowered(raw, "service"), U.lowered(new, "service"), keys, U.COSTS), "billed_cost")


@query("costs_load", f"WITH old AS ({HALF_SQL}) SELECT charge_date, lower(service) AS service, count(*) AS n, round(sum(CASE WHEN month(charge_date) % 2 = 0 THEN billed_cost * 3 ELSE billed_cost END), 4) AS billed_cost FROM old GROUP BY 1, 2")
def costs_load(v):
    """A table by month, of which a load rewrites every second month in place."""
    keys = ["month", "entity_id", "charge_date", "service", "sku"]
    raw = v.costs.withColumn("month", F.trunc("charge_date", "month")).groupBy(*keys).agg(F.max("billed_cost").alias("billed_cost"))
    path = S.work_folder(v.spark)
    U.upsert_partitions(path, U.lowered(raw, "service"), keys, U.COSTS, "month")
    # the rows of the load are those that are stored, dearer; what they were summed from isn't read again
    stored = v.spark.read.parquet(path).where("month(month) % 2 = 0").select(*keys, "billed_cost")
    new = stored.withColumns({"service": F.upper("service"), "billed_cost": F.col("billed_cost") * 3})
    U.upsert_partitions(path, U.lowered(new, "service"), keys, U.COSTS, "month")
    return rounded(v.spark.read.parquet(path).groupBy("charge_date", "service").agg(F.count(F.lit(1)).alias("n"), F.sum("billed_cost").alias("billed_cost")), "billed_cost")


@query("metrics_insert", "SELECT entity_id, metric, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, min(value) AS value FROM metrics GROUP BY 1, 2, 3")
def metrics_insert(v):
    keys = ["entity_id", "metric", "hour"]
    rows = v.metrics.withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    have = rows.groupBy(*keys).agg(F.min("value").alias("value"))
    return U.upsert(have, rows.groupBy(*keys).agg(F.max("value").alias("value")), keys, U.METRICS)


@query("kubemetrics_upsert", "SELECT entity_id, date, metric, round(max(value), 4) AS value FROM kube_metrics GROUP BY 1, 2, 3")
def kubemetrics_upsert(v):
    keys = ["entity_id", "date", "metric"]
    have = v.kube_metrics.groupBy(*keys).agg(F.min("value").alias("value"))
    return rounded(U.upsert(have, U.latest(v.kube_metrics, keys, "value"), keys, U.KUBE_METRICS), "value")


@query("krr_upsert", "SELECT entity_id, workload_type, workload, container, max(scanned) AS scanned FROM recommendations GROUP BY 1, 2, 3, 4")
def krr_upsert(v):
    keys = ["entity_id", "workload_type", "workload", "container"]
    rows = U.stamped(v.recommendations.withColumnRenamed("scanned", "envelope_time"))
    old = U.latest(rows, keys, "scanned", first=True)
    out = U.upsert(old, U.latest(rows, keys, "scanned"), keys, {"scanned": "replace", "cpu": "replace", "memory": "replace"})
    return out.select(*keys, F.to_date("scanned").alias("scanned"))


@query("entity_upsert_basic", f"""
    SELECT lower(concat('Id', id)) AS external_id, CASE WHEN id % 4 = 2 THEN 9 ELSE parent_id END AS parent_id, CASE WHEN id % 5 = 0 THEN lower(concat('Id', id)) ELSE lower(name) END AS name,
      CASE WHEN id % 2 = 0 THEN 'changed' ELSE type END AS type, CASE WHEN id % 2 = 0 THEN DATE '{AS_OF}' ELSE updated_at END AS updated_at FROM entities""")
def entity_upsert_basic(v):
    rows = v.entities.withColumn("external_id", F.concat(F.lit("Id"), F.col("id").cast("string")))
    name = F.when(F.col("id") % 5 == 0, F.lit("None")).otherwise(F.col("name"))
    kept = ["external_id", "provider", "name", "type", "parent_id", "updated_at"]
    parent = F.when(F.col("id") % 4 == 2, 9).otherwise(0).cast("long")
    new = rows.where("id % 2 = 0").withColumns({"name": F.lit("Other"), "type": F.lit("Changed"), "updated_at": F.lit(AS_OF), "parent_id": parent})
    old = U.basic_entities(rows.withColumn("name", name).select(*kept))
    return U.upsert(old, U.basic_entities(new.select(*kept)), ["external_id"], U.ENTITY_BASIC).drop("provider")


@query("entity_upsert_cost", "SELECT id, CASE WHEN id % 2 = 0 THEN concat_ws(',', segment, 'x', team) ELSE concat_ws(',', segment, tier, team) END AS tags, CASE WHEN id % 2 = 0 THEN 'r9' ELSE region END AS region FROM entities WHERE type = 'vm'")
def entity_upsert_cost(v):
    old = v.entities.where("type = 'vm'").select("id", "tags", "region")
    new = old.where("id % 2 = 0").select("id", F.create_map(F.lit("tier"), F.lit("x")).alias("tags"), F.lit("r9").alias("region"))
    out = U.upsert(old, new, ["id"], U.ENTITY_COST)
    return out.select("id", F.concat_ws(",", *[F.try_element_at("tags", F.lit(k)) for k in ("segment", "tier", "team")]).alias("tags"), "region")


@query("entity_upsert_metric", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE coalesce(tier, '-') END AS tier FROM entities")
def entity_upsert_metric(v):
    old = v.entities.select("id", "tags", F.when(F.col("id") % 2 == 0, N.meta_hash(tags_key(F.col("tags")))).alias("meta_hash"))
    tags = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("tier"), F.lit("new"))).otherwise(F.col("tags"))
    new = v.entities.select("id", tags.alias("tags")).withColumn("meta_hash", N.meta_hash(tags_key(F.col("tags"))))
    out = U.upsert(old, new, ["id"], U.ENTITY_METRIC, only_if=U.differs("meta_hash"))
    return out.select("id", F.coalesce(F.try_element_at("tags", F.lit("tier")), F.lit("-")).alias("tier"))


@query("entity_upsert_kube", "SELECT id, CASE WHEN id % 2 = 0 THEN 7 ELSE parent_id END AS parent_id, concat_ws(',', cluster, CASE WHEN id % 2 = 0 THEN 'b' END, team) AS tags FROM entities WHERE type = 'kubernetes_namespace'")
def entity_upsert_kube(v):
    old = v.entities.where("type = 'kubernetes_namespace'").select("id", "parent_id", "tags")
    new = old.where("id % 2 = 0").select("id", F.lit(7).alias("parent_id"), F.create_map(F.lit("label"), F.lit("b")).alias("tags"))
    out = U.upsert(old, new, ["id"], U.ENTITY_KUBE)
    return out.select("id", "parent_id", F.concat_ws(",", *[F.try_element_at("tags", F.lit(k)) for k in ("cluster", "label", "team")]).alias("tags"))


@query("kube_hierarchy", """
    SELECT lower(concat('urn:', cluster, ':', name)) AS external_id, lower(name) AS name, type, lower(concat('urn:', cluster)) AS parent_external_id FROM entities WHERE type = 'kubernetes_namespace'
    UNION ALL SELECT DISTINCT lower(concat('urn:', cluster)), lower(cluster), 'kubernetes_cluster', NULL FROM entities WHERE type = 'kubernetes_namespace'""")
def kube_hierarchy(v):
    rows = v.entities.where("type = 'kubernetes_namespace'")
    rows = rows.select(F.concat(F.lit("Urn:"), "cluster", F.lit(":"), "name").alias("resource_id"), F.col("name").alias("resource_name"), F.col("type").alias("resource_type"), "provider", "tags")
    return U.kube_entities(rows).select("external_id", "name", "type", "parent_external_id")


@query("azure_hierarchy", "SELECT concat('/subscriptions/', c_nationkey) AS external_id, 'subscription' AS type, NULL AS parent_external_id FROM customer UNION SELECT concat('/subscriptions/', c_nationkey, '/resourcegroups/', lower(c_mktsegment)), 'resource_group', concat('/subscriptions/', c_nationkey) FROM customer")
def azure_hierarchy(v):
    rows = v.customer.select(F.concat(F.lit("/subscriptions/"), F.col("c_nationkey").cast("string"), F.lit("/resourceGroups/"), "c_mktsegment", F.lit("/providers/x/vm/"), "c_name").alias("resource_id"))
    return U.azure_hierarchy(rows).select("external_id", "type", "parent_external_id")


@query("aws_hierarchy", "SELECT DISTINCT CAST(c_nationkey AS STRING) AS external_id, 'account' AS type FROM customer")
def aws_hierarchy(v):
    rows = v.customer.select(F.lit("aws").alias("provider"), F.lit("b").alias("billing_id"), F.lit("B").alias("billing_name"), F.col("c_nationkey").cast("string").alias("account_id"), F.lit("A").alias("account_name"))
    return U.billing_hierarchy(rows).where("type = 'account'").select("external_id", "type")


@query("billing_hierarchy", f"""
    WITH f AS (SELECT * FROM focus_raw WHERE ProviderName <> 'Other' AND EffectiveCost <> 0 AND ChargeCategory <> 'Credit' AND start_date >= DATE '{FOCUS_CUTOFF}' AND end_date - start_date <= 1)
    SELECT BillingAccountId AS external_id, 'billing_account' AS type FROM f UNION SELECT split_part(SubAccountId, '/', -1), max(CASE WHEN ProviderName LIKE 'Micro%' THEN 'subscription' ELSE 'account' END) FROM f GROUP BY 1""")
def billing_hierarchy(v):
    rows = U.billing_hierarchy(X.focus_normalize(X.focus_daily_charges(v.focus_raw, FOCUS_CUTOFF)))
    return rows.select("external_id", "type")


@query("hardware_upsert", "SELECT instance_type, CASE WHEN vcpu > 20 THEN vcpu + 1 ELSE vcpu END AS vcpu, CASE WHEN vcpu > 20 THEN 'new' ELSE family END AS family FROM hardware")
def hardware_upsert(v):
    old = v.hardware
    new = old.withColumn("family", F.lit("new")).withColumn("vcpu", F.when(F.col("vcpu") > 20, F.col("vcpu") + 1).otherwise(F.col("vcpu")))
    policy = {c: "replace" for c in old.columns}
    return U.upsert(old, new, ["cloud", "instance_type"], policy, only_if=U.differs(*U.HARDWARE_COMPARED)).select("instance_type", "vcpu", "family")


@query("pricing_upsert", "SELECT instance_type, region, os, round(CASE WHEN os = 'linux' THEN hourly_price * 2 ELSE hourly_price END, 6) AS hourly_price FROM pricing")
def pricing_upsert(v):
    keys = ["cloud", "instance_type", "region", "os"]
    new = v.pricing.where("os = 'linux'").withColumn("hourly_price", F.col("hourly_price") * 2)
    out = U.upsert(v.pricing, new, keys, {"hourly_price": "replace"}, only_if=U.differs("hourly_price"))
    return rounded(out.select(*keys[1:], "hourly_price"), "hourly_price", digits=6)


@query("pricing_dedupe", "SELECT cloud, instance_type, region, os, round(min(hourly_price), 6) AS hourly_price FROM (SELECT * FROM pricing UNION ALL SELECT cloud, instance_type, region, os, hourly_price * 0.5 FROM pricing WHERE region < 'B') GROUP BY 1, 2, 3, 4")
def pricing_dedupe(v):
    more = v.pricing.where("region < 'B'").withColumn("hourly_price", F.col("hourly_price") * 0.5)
    return rounded(U.pricing_dedupe(v.pricing.union(more)), "hourly_price", digits=6)


# streams

LINE_SQL = "SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 'broken' WHEN event_type = 'error' THEN 'other' ELSE event_type END AS route FROM events"


def envelopes(v, folder: str, load: int) -> None:
    """Add event rows as JSON envelopes in text files; one in a hundred is broken. The second load brings two thirds of the events again, with other values."""
    rows = v.events if load == 1 else v.events.where("event_id % 3 <> 0").withColumn("value", F.col("value") + 1000)
    rows = rows.where("event_id % 3 <> 1") if load == 1 else rows
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("message_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("source_module"), F.to_json(F.struct("event_id", "user_id", "value")).alias("payload")))
    rows.select(F.when(F.col("event_id") % 100 == 0, "{broken").otherwise(body).alias("value")).write.mode("append").text(f"{folder}/in")


STORED_SQL = f"SELECT CASE WHEN route IN ('other', 'broken') THEN 'rejected' ELSE route END AS route, event_id, CASE WHEN route IN ('other', 'broken') THEN 0 WHEN event_id % 3 = 1 THEN value + 1000 ELSE value END AS value FROM ({LINE_SQL}) JOIN events USING (event_id)"


@query("ingest_stream", f"SELECT route, count(*) + CASE WHEN route = 'rejected' THEN any_value(again) ELSE 0 END AS n, round(sum(value), 3) AS total FROM ({STORED_SQL}), (SELECT count(*) AS again FROM ({LINE_SQL}) WHERE event_id % 3 = 2 AND route IN ('other', 'broken')) GROUP BY 1")
def ingest_stream(v):
    """Two loads of envelopes into a stored table that keeps first values, and their batches replayed under the table's ledger."""
    folder = S.work_folder(v.spark)
    rejected = S.folder_sink(f"{folder}/rejected")
    shape = "struct<event_id:long,user_id:long,value:double>"
    ledger = S.Ledger(v.spark, f"{folder}/ledger")
    table = ledger.once(S.table_sink(f"{folder}/points", shape, ["event_id", "value"], ["event_id"], {}, F.to_date("timestamp"), S.folder_sink(f"{folder}/unfit")))
    sinks = dict.fromkeys(["click", "view", "purchase", "signup"], table)
    for load in (1, 2):
        envelopes(v, folder, load)
        S.ingest_stream(v.spark.readStream.text(f"{folder}/in"), sinks, rejected, f"{folder}/checkpoint").awaitTermination()
    # the same input from the start: its first batch has an id that the ledger holds
    S.ingest_stream(v.spark.readStream.text(f"{folder}/in"), sinks, S.folder_sink(f"{folder}/replayed"), f"{folder}/again").awaitTermination()
    stored = v.spark.read.parquet(f"{folder}/points").select(F.col("source_module").alias("route"), "value")
    refused = v.spark.read.parquet(f"{folder}/rejected").select(F.lit("rejected").alias("route"), F.lit(0.0).alias("value"))
    return stored.union(refused).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("reject_invalid", "SELECT event_id % 3 = 0 AS rejected, count(*) AS n FROM events GROUP BY 1")
def reject_invalid(v):
    body = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("user_id"))).otherwise(F.to_json(F.struct("user_id", "value")))
    good, bad = S.reject_invalid(v.events.select("event_id", body.alias("payload")), "struct<user_id:long,value:double>", ["user_id", "value"])
    return good.select(F.lit(False).alias("rejected")).union(bad.select(F.lit(True).alias("rejected"))).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


#: Two loads of metrics: the entities of the second one come late.
LATE = "entity_id % 10 = 3"
CLOSED_SQL = f"(SELECT max(ts) - INTERVAL 2 DAY AS first_mark FROM metrics WHERE NOT {LATE}), (SELECT max(ts) - INTERVAL 2 DAY AS last_mark FROM metrics)"


@query("rollup_stream", shown_sql(f"SELECT entity_id, metric, date_trunc('hour', ts) AS bucket, {STATS_SQL} FROM metrics, {CLOSED_SQL} WHERE (NOT {LATE} OR date_trunc('hour', ts) + INTERVAL 1 HOUR > first_mark) AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= last_mark GROUP BY 1, 2, 3", "entity_id", "metric"))
def rollup_stream(v):
    """Closed buckets of a stream in append mode, over two loads; what the second has for buckets that the first one closed is left out."""
    folder = S.work_folder(v.spark)
    out = None
    for load in (f"NOT {LATE}", LATE):
        v.metrics.where(load).write.mode("append").parquet(f"{folder}/in")
        out = S.run_append(S.stream_rollup(v.spark.readStream.schema(v.metrics.schema).parquet(f"{folder}/in")), folder)
    return shown(out)


REFRESH_DAYS = 14


@query("rollup_refresh", shown_sql(f"SELECT entity_id, metric, date_trunc('hour', ts) AS bucket, {STATS_SQL} FROM metrics WHERE NOT (minute(ts) % 7 = 0) OR (date_trunc('hour', ts) >= TIMESTAMP '{METRICS_AS_OF}' - INTERVAL {REFRESH_DAYS} DAY AND date_trunc('hour', ts) <= TIMESTAMP '{METRICS_AS_OF}' - INTERVAL 2 HOUR) GROUP BY 1, 2, 3", "entity_id", "metric"))
def rollup_refresh(v):
    """A stored rollup after a refresh of the buckets that late points touched within the refresh window."""
    folder = S.work_folder(v.spark)
    late = "minute(ts) % 7 = 0"
    v.metrics.withColumn("day", F.to_date("ts")).hint("rebalance", F.col("day")).write.partitionBy("day").parquet(f"{folder}/points")
    points = v.spark.read.parquet(f"{folder}/points")
    Y.save_rollup(points.where(f"NOT ({late})").drop("day"), f"{folder}/hourly")
    now = dt.datetime.combine(METRICS_AS_OF, dt.time())
    touched = Y.inside_window(Y.touched_buckets(points.where(late).drop("day")), now, dt.timedelta(days=REFRESH_DAYS), dt.timedelta(hours=1))
    Y.refresh_rollup(points, f"{folder}/hourly", touched)
    return shown(v.spark.read.parquet(f"{folder}/hourly").select("bucket", "entity_id", "metric", *Y.STATISTICS))


@query("first_write_stream", f"""
    WITH marks AS (SELECT * FROM {CLOSED_SQL}),
    one AS (SELECT entity_id, metric, ts, min(value) AS value FROM metrics WHERE NOT {LATE} GROUP BY 1, 2, 3),
    two AS (SELECT entity_id, metric, ts, min(value) + 1000 AS value FROM metrics, marks WHERE {LATE} AND ts > date_trunc('milliseconds', first_mark) GROUP BY 1, 2, 3)
    SELECT entity_id, metric, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 4) AS value FROM (SELECT * FROM one UNION ALL SELECT * FROM two)""")
def first_write_stream(v):
    """First values of every point over two loads; the second has other values for the first one's points, and points of late entities."""
    folder = S.work_folder(v.spark)
    out = None
    for rows in (v.metrics.where(f"NOT ({LATE})"), v.metrics.withColumn("value", F.col("value") + 1000)):
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = v.spark.readStream.schema(v.metrics.schema).parquet(f"{folder}/in")
        out = S.run_append(S.first_values(stream, ["entity_id", "metric"], "value"), folder)
    return rounded(out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "value")


@query("chargeback_dashboard", f"""
    WITH {CLUSTER_DAILY_SQL}, f AS (SELECT scope_id, arg_max(projected_amount, forecast_date) AS cached FROM forecast_history WHERE target_month = DATE '{START}' AND forecast_date >= DATE '1996-07-30' GROUP BY 1),
    live AS (SELECT scope_id, sum(cost) FILTER (date >= DATE '{START}' AND date <= DATE '{CUTOFF}') + 11 * avg(cost) FILTER (date > DATE '{CUTOFF}' - 7 AND date <= DATE '{CUTOFF}') AS total FROM cluster_daily GROUP BY 1),
    b AS (SELECT scope_id, arg_max(limit_amount, month) AS budget FROM budgets WHERE month <= DATE '{START}' GROUP BY 1)
    SELECT scope_id, round(coalesce(cached, total), 3) AS projected_total, cached IS NOT NULL AS from_cache, round(budget, 3) AS budget FROM live LEFT JOIN f USING (scope_id) LEFT JOIN b USING (scope_id)""")
def chargeback_dashboard(v):
    """Projected totals: a recent stored forecast, else actual costs plus the moving average."""
    cached = B.forecast_latest(v.forecast_history, SCOPE, START, dt.date(1996, 7, 30)).select("scope_id", F.col("projected_amount").alias("cached"))
    live = month_days(v).groupBy("scope_id").agg(F.sum("value").alias("total"))
    limits = B.budget_asof(v.budgets, v.budgets.select("scope_id").distinct().withColumn("month", F.lit(START)), SCOPE).select("scope_id", F.col("limit_amount").alias("budget"))
    rows = live.join(cached, SCOPE, "left").join(limits, SCOPE, "left")
    return rounded(rows.select("scope_id", F.coalesce("cached", "total").alias("projected_total"), F.col("cached").isNotNull().alias("from_cache"), "budget"), "projected_total", "budget", digits=3)
