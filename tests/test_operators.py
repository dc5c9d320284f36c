"""Golden cases and properties of the cost operators."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costloom.functions.tables import durable
from costloom.functions import normalize as N
from costloom.functions.tags import tags_contain, tags_key, tags_match, tags_merge
from costloom.functions.timegrid import iso_period_minutes, month_window
from costloom.operators import budgets as B
from costloom.operators import costs as C
from costloom.operators import hierarchy as H
from costloom.operators import metrics as M
from costloom.operators import upsert as U
from costloom.sources import focus as X

D = dt.date
TAGS = "map<string,string>"


def one(df):
    return [tuple(r) for r in df.collect()]


def test_tags(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"}, {"a": "1"}), ({"a": "2"}, {"a": "1"}), ({"a": "1"}, {}), (None, {"a": "1"})], f"t {TAGS}, r {TAGS}")
    rows = one(df.select(tags_key(F.col("t")), F.coalesce(tags_contain(F.col("t"), F.col("r")), F.lit(False)), F.coalesce(tags_match(F.col("t"), F.col("r")), F.lit(False))))
    assert rows == [('{"a":"1","b":"2"}', True, True), ('{"a":"2"}', False, False), ('{"a":"1"}', True, False), ("{}", False, False)]
    merged = one(df.select(tags_key(tags_merge(F.col("t"), F.col("r")))))
    assert [m[0] for m in merged] == ['{"a":"1","b":"2"}', '{"a":"1"}', '{"a":"1"}', '{"a":"1"}']


def test_periods_and_months(spark):
    df = spark.createDataFrame([("PT5M",), ("PT1H",), ("P1D",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(iso_period_minutes(F.col("p"))).collect()] == [5, 60, 1440, 5, 5]
    assert month_window(D(2024, 12, 9)) == (D(2024, 12, 1), D(2025, 1, 1))


def test_closure_and_scopes(spark):
    e = spark.createDataFrame([(0, None, {}), (1, 0, {"t": "a"}), (2, 1, {"t": "b"}), (3, 2, {"t": "a"})], f"id long, parent_id long, tags {TAGS}")
    tree = H.closure(e)
    assert sorted((r["ancestor"], r["descendant"], r["depth"]) for r in tree.collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0)]
    scopes = spark.createDataFrame([(1, {"t": "a"}), (1, {})], f"scope_id long, tags {TAGS}")
    got = sorted((r["tags_key"], r["entity_id"]) for r in H.scope_entities(tree, e, scopes).collect())
    assert got == [('{"t":"a"}', 3), ("{}", 2), ("{}", 3)]


@pytest.mark.parametrize("n", [60, 200])
def test_closure_has_no_limit_of_depth(spark, n):
    tree = H.closure(spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id long, parent_id long")).collect()
    assert len(tree) == n * (n + 1) // 2
    assert all(r["depth"] == r["descendant"] - r["ancestor"] and list(r["path"]) == list(range(r["ancestor"], r["descendant"] + 1)) for r in tree)


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        H.closure(spark.createDataFrame([(0, None), (1, 3), (2, 1), (3, 2)], "id long, parent_id long"))


@pytest.mark.parametrize("frontier", [2, 64])
def test_cheapest_fits_are_those_of_brute_force(spark, frontier):
    import random

    from costloom.operators import rightsizing as R

    rng = random.Random(3)
    flags = {f: [True, False] for f in R.FLAGS} | {"architecture": ["x86_64", "arm64"]}
    offers = [{"provider": "p", "region": rng.choice("ab"), "os": "linux", "candidate": f"t{i:03}", "candidate_price": float(rng.randint(1, 40)), "c_vcpu": rng.randint(1, 16), "c_memory": float(rng.randint(1, 64)), "baseline_iops": rng.choice([None, 100.0, 900.0]), "throughput": rng.choice([None, 50.0]), **{"c_" + f: rng.choice(v) for f, v in flags.items()}} for i in range(150)]
    vms = [{"id": i, "provider": "p", "region": rng.choice("abc"), "os": "linux", "price": rng.choice([None, 0.0, 5.0, 20.0, 60.0]), "need_vcpu": float(rng.randint(1, 17)), "need_ram": float(rng.randint(1, 50)), "need_iops": rng.choice([0.0, 500.0]), "need_net": rng.choice([0.0, 60.0]), **{f: rng.choice(v) for f, v in flags.items()}} for i in range(60)]
    kinds = ", ".join(f"{f} {'string' if f == 'architecture' else 'boolean'}" for f in R.FLAGS)
    shape_vm = f"id long, provider string, region string, os string, price double, need_vcpu double, need_ram double, need_iops double, need_net double, {kinds}"
    shape_offer = f"provider string, region string, os string, candidate string, candidate_price double, c_vcpu int, c_memory double, baseline_iops double, throughput double, {', '.join('c_' + k for k in kinds.split(', '))}"
    found = R.cheapest(spark.createDataFrame(vms, shape_vm), spark.createDataFrame(offers, shape_offer), frontier).collect()
    want = set()
    for m in vms:
        seen = set()
        for o in sorted((o for o in offers if o["region"] == m["region"]), key=lambda o: (o["candidate_price"], o["candidate"])):
            if m["price"] and not o["candidate_price"] < m["price"]:
                continue
            if o["c_vcpu"] < m["need_vcpu"] or o["c_memory"] < m["need_ram"] or (o["baseline_iops"] or 1e9) < m["need_iops"] or (o["throughput"] or 1e9) < m["need_net"] or o["c_is_gpu"] != m["is_gpu"]:
                continue
            w = tuple(n for n, bad in (("architecture", o["c_architecture"] != m["architecture"]), ("confidential", m["is_confidential"] and not o["c_is_confidential"]), ("local storage", m["has_local_storage"] and not o["c_has_local_storage"]), ("premium storage", m["supports_premium"] and not o["c_supports_premium"])) if bad)
            if w not in seen:
                seen.add(w)
                want.add((m["id"], o["candidate"], w))
            if not w:
                break
    assert {(r["id"], r["candidate"], tuple(r["warnings"])) for r in found} == want and len(found) == len(want)


def test_multiday_charges_are_spread(spark):
    df = spark.createDataFrame([("r", D(2026, 3, 1), D(2026, 3, 4), 30.0)], "resource_id string, start_date date, end_date date, billed_cost double")
    rows = one(X.spread_multiday(df, D(2026, 4, 1)).select("start_date", "billed_cost").orderBy("start_date"))
    assert rows == [(D(2026, 3, d), 10.0) for d in (1, 2, 3)]
    assert X.spread_multiday(df, D(2026, 3, 1)).count() == 0
    assert one(X.spread_multiday(df, D(2026, 3, 3)).select("billed_cost")) == [(15.0,), (15.0,)]
    assert one(X.spread_multiday(df, D(2026, 3, 3), mode="full").select("billed_cost")) == [(10.0,), (10.0,)]


def test_providers_and_accounts(spark):
    df = spark.createDataFrame([("Amazon Web Services", "1"), ("Microsoft Azure", "/subscriptions/abc-123-def"), (None, None)], "p string, a string")
    assert one(df.select(N.provider_of(F.col("p")), N.account_of(F.col("a")))) == [("aws", "1"), ("azure", "abc-123-def"), ("unknown", None)]


def test_allocation_adds_and_takes(spark):
    scopes = spark.createDataFrame([(1, {"p": "t"}), (1, {"p": "s"}), (1, {})], f"scope_id long, tags {TAGS}")
    base = H.with_key(scopes).select("scope_id", "tags_key", F.lit(D(2024, 1, 1)).alias("date"), F.lit(100.0).alias("cost"))
    rules = spark.createDataFrame([(1, {"p": "s"}, {"p": "t"}, 50.0)], f"rule_id int, source_tags {TAGS}, target_tags {TAGS}, percentage double")
    source = spark.createDataFrame([('{"p":"s"}', D(2024, 1, 1), 200.0)], "tags_key string, date date, cost double")
    got = dict(one(C.apply_allocation_rules(base, scopes, rules, source).select("tags_key", "cost")))
    assert got == {'{"p":"t"}': 200.0, '{"p":"s"}': 0.0, "{}": 100.0}


def test_namespace_shares_and_allocation(spark):
    e = spark.createDataFrame([(1, None, "c"), (2, 1, "a"), (3, 1, "b")], "id long, parent_id long, name string")
    k = spark.createDataFrame([(2, D(2024, 1, 1), "cpu", 1.0), (2, D(2024, 1, 1), "cpu", 3.0), (3, D(2024, 1, 1), "cpu", 6.0)], "entity_id long, date date, metric string, value double")
    share = C.ns_metric_share(k, e, "cpu", D(2024, 1, 1), D(2024, 1, 3))
    assert sorted(one(share.select("namespace", "date", "share")), key=str) == sorted([("a", D(2024, 1, 1), 0.25), ("b", D(2024, 1, 1), 0.75), ("a", D(2024, 1, 2), None), ("b", D(2024, 1, 2), None)], key=str)
    costs = spark.createDataFrame([(1, D(2024, 1, 1), 100.0)], "cluster_id long, date date, cost double")
    got = C.ns_allocation(share, share, costs).where("date = '2024-01-01'")
    assert sorted(round(r["cost"], 6) for r in got.collect()) == [25.0, 75.0]


def test_top_categories(spark):
    rows = [(1, D(2024, 1, 1), f"c{i}", float(i)) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "scope_id long, date date, category string, cost double")
    got = {r["category"]: r["cost"] for r in C.topn_other(df, ["scope_id"], n=3).collect()}
    assert got == {"c7": 7.0, "c6": 6.0, "c5": 5.0, "other": 10.0}


def test_moving_average_and_report(spark):
    days = [(1, D(2024, 1, 1) + dt.timedelta(days=k), 100.0 if k < 15 else 0.0) for k in range(31)]
    daily = spark.createDataFrame(days, "scope_id long, date date, cost double")
    cutoff = D(2024, 1, 15)
    ahead = B.forecast_sma(daily.where(F.col("date") <= F.lit(cutoff)), ["scope_id"], 16)
    report = C.month_report(daily, ahead, ["scope_id"], cutoff)
    got = {r["date"]: (r["actual_cumulative"], r["forecast_cumulative"]) for r in report.collect()}
    assert got[D(2024, 1, 15)] == (1500.0, 1500.0) and got[D(2024, 1, 16)] == (None, 1600.0) and got[D(2024, 1, 14)] == (1400.0, None)


def test_forecasts_follow_a_season(spark):
    y = 50 + 10 * np.sin(np.arange(56) * 2 * np.pi / 7)
    fitted, ahead, dev = B.holt_winters(y, 7)
    assert np.abs(ahead - y[:7]).max() < 1.0 and dev < 5
    short = spark.createDataFrame([(1, D(2024, 1, 1), 1.0)], "scope_id long, date date, cost double")
    assert B.forecast(short, ["scope_id"], D(2024, 2, 1)).count() == 0


def test_anomalies(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), 100.0, 10.0, 20.0), (1, D(2024, 1, 2), 12.0, 10.0, 11.0)], "scope_id long, date date, y double, yhat double, hi double")
    assert one(B.anomaly_detect(df, ["scope_id"]).select("anomaly_date", "delta")) == [(D(2024, 1, 1), 90.0)]


def test_budget_breach_has_two_days(spark):
    days = spark.createDataFrame([(1, D(2024, 3, 30), 10.0, False), (1, D(2024, 3, 30 + 1), 150.0, True)], "scope_id long, date date, value double, is_forecast boolean")
    limits = spark.createDataFrame([(1, 50.0)], "scope_id long, limit_amount double")
    assert one(B.budget_breach(days, limits, ["scope_id"]).select("anomaly_date", "threshold")) == [(D(2024, 3, 31), 50.0)]
    days = spark.createDataFrame([(1, D(2024, 3, k), 20.0, True) for k in (28, 29, 30, 31)], "scope_id long, date date, value double, is_forecast boolean")
    assert sorted(one(B.budget_breach(days, limits, ["scope_id"]).select("anomaly_date"))) == [(D(2024, 3, 30),), (D(2024, 3, 31),)]


def test_forecast_quality_golden(spark):
    h = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 5), 80.0), (1, D(2024, 1, 1), D(2024, 1, 9), 120.0)], "scope_id long, target_month date, forecast_date date, projected_amount double")
    r = B.forecast_quality(h, ["scope_id"]).first()
    assert (r["projected"], r["actual"], r["variance"], r["accuracy"]) == (100.0, 120.0, 20.0, 80.0)


def test_source_routing():
    assert M.metric_source_pick(1800).name == "metrics" and M.metric_source_pick(3600).name == "metrics_hourly" and M.metric_source_pick(10 * M.DAY).name == "metrics_daily"
    assert M.telemetry_source_pick(5 * M.DAY).name == "metrics" and M.telemetry_source_pick(60 * M.DAY).name == "metrics_daily"
    with pytest.raises(ValueError):
        M.check_hierarchy([M.Source("a", 3600, 1), M.Source("b", 5000, 1)])


def test_humanized(spark):
    df = spark.createDataFrame([("0.25",), ("2",), (None,), ("abc",), ("1073741824",)], "x string")
    assert one(df.select(N.humanize_cpu(F.col("x")), N.humanize_memory(F.col("x"))))[:4] == [("250m", "0 B"), ("2.00", "2 B"), ("-", "-"), ("abc", "abc")]
    assert one(df.select(N.humanize_memory(F.col("x"))))[4] == ("1.00 Gi",)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-9, 9)), max_size=8), st.lists(st.tuples(st.integers(0, 5), st.integers(-9, 9)), max_size=8))
def test_upsert_is_idempotent(spark, old, new):
    shape = "k int, v int"
    target = spark.createDataFrame(list(dict(old).items()), shape)
    source = U.latest(spark.createDataFrame(new, shape), ["k"], "v")
    once = U.upsert(target, source, ["k"], {"v": "replace"})
    want = dict(old)
    want.update({k: max(v for i, v in new if i == k) for k, _ in new})
    assert dict(one(once)) == want and dict(one(U.upsert(once, source, ["k"], {"v": "replace"}))) == want


def test_rollup_of_rollup_is_the_rollup(spark):
    rows = [(1, "m", dt.datetime(2024, 1, 1 + k // 48, (k // 2) % 24, 30 * (k % 2)), float(k * k % 17)) for k in range(96)]
    df = spark.createDataFrame(rows, "entity_id long, metric string, ts timestamp, value double")
    direct, nested = M.rollup_first(df, "1 day"), M.rollup_next(M.rollup_first(df))
    assert sorted(one(direct)) == sorted(one(nested))


def test_entities_as_stored(spark):
    rows = spark.createDataFrame([("A:B:C", "AWS", None, "VM"), ("X", "aws", "None", "vm"), ("Y", "aws", "Name", "vm")], "external_id string, provider string, name string, type string")
    assert one(U.basic_entities(rows)) == [("a:b:c", "aws", "a:b:c", "vm"), ("x", "aws", "x", "vm"), ("y", "aws", "name", "vm")]
    assert one(rows.select(U.cluster_of(F.col("external_id")))) == [("a:b",), ("",), ("",)]
    old = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "external_id string, parent_id long")
    new = spark.createDataFrame([("a", 0), ("b", 7), ("c", None), ("d", 0)], "external_id string, parent_id long")
    assert dict(one(U.upsert(old, new, ["external_id"], U.ENTITY_BASIC))) == {"a": 5, "b": 7, "c": 5, "d": 0}


def test_partitions_are_rewritten_in_place(spark, tmp_path):
    path = str(tmp_path / "table")
    shape = "p int, k int, v int"
    U.upsert_partitions(path, spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 30)], shape), ["p", "k"], {"v": "replace"}, "p")
    other = sorted((tmp_path / "table" / "p=2").glob("*.parquet"))
    source = spark.createDataFrame([(1, 2, 21), (3, 1, 40)], shape)
    for _ in range(2):
        U.upsert_partitions(path, source, ["p", "k"], {"v": "replace"}, "p")
        assert sorted(one(spark.read.parquet(path).select("p", "k", "v"))) == [(1, 1, 10), (1, 2, 21), (2, 1, 30), (3, 1, 40)]
    assert sorted((tmp_path / "table" / "p=2").glob("*.parquet")) == other
    with pytest.raises(ValueError):
        U.upsert_partitions(path, source, ["k"], {"v": "replace"}, "p")


def test_unfinished_snapshots_are_not_seen(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert U.publish(spark.range(3), folder) == 1 and U.publish(spark.range(5), folder) == 2
    spark.range(9).write.parquet(f"{folder}/snapshot=3")
    (tmp_path / "table" / "snapshot=3" / "_SUCCESS").unlink()
    assert U.current(spark, folder).count() == 5
    assert U.publish(spark.range(7), folder) == 3 and U.current(spark, folder).count() == 7


def test_report_has_anomalies_budget_and_total(spark):
    daily = spark.createDataFrame([(1, D(2024, 1, d), 10.0 if d < 3 else 0.0) for d in (1, 2, 3, 4)] + [(2, D(2024, 1, 1), 1.0)], "scope_id long, date date, cost double")
    ahead = spark.createDataFrame([(1, D(2024, 1, 3), 5.0), (1, D(2024, 1, 4), -5.0)], "scope_id long, date date, predicted double")
    thresholds = spark.createDataFrame([(1, D(2024, 1, 2), 4.0), (1, D(2024, 1, 3), 0.0)], "scope_id long, date date, threshold double")
    limits = spark.createDataFrame([(1, 50.0)], "scope_id long, limit_amount double")
    rows = C.month_report(daily, ahead, ["scope_id"], D(2024, 1, 2), thresholds, limits).orderBy("scope_id", "date").collect()
    assert [(r["is_anomaly"], r["anomaly_delta"], r["projected_total"], r["budget"]) for r in rows] == [(False, 0.0, 25.0, 50.0), (True, 6.0, 25.0, 50.0), (False, 0.0, 25.0, 50.0), (False, 0.0, 25.0, 50.0), (False, 0.0, 1.0, None)]


def test_month_breakdown_fills_days(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), "a", 5.0), (1, D(2024, 1, 2), "b", 1.0), (1, D(2024, 1, 2), "c", 2.0), (1, D(2024, 1, 4), "d", 99.0)], "scope_id long, date date, category string, cost double")
    got = C.month_breakdown(df, ["scope_id"], D(2024, 1, 1), D(2024, 1, 4), D(2024, 1, 2), n=1)
    assert sorted(one(got.select("category", "date", "cost")), key=str) == sorted([("a", D(2024, 1, 1), 5.0), ("a", D(2024, 1, 2), 0.0), ("a", D(2024, 1, 3), None), ("other", D(2024, 1, 1), 0.0), ("other", D(2024, 1, 2), 3.0), ("other", D(2024, 1, 3), None)], key=str)


def test_rule_tables_change(spark):
    shape = f"rule_id int, source_tags {TAGS}, percentage double"
    rules = spark.createDataFrame([(1, {"a": "x"}, 60.0), (2, {"a": "y"}, 10.0)], shape)
    new = spark.createDataFrame([(3, {"a": "x"}, 50.0), (4, {"a": "y"}, 90.0)], shape)
    assert sorted(r["rule_id"] for r in C.add_rules(rules, new).collect()) == [1, 2, 4]
    gone = spark.createDataFrame([(1,), (1,), (9,)], "rule_id int")
    left = C.delete_rules(rules, gone)
    assert sorted(r["rule_id"] for r in C.add_rules(left, new).collect()) == [2, 3, 4]
    tagged = spark.createDataFrame([(1, {"a": "x", "b": "z"}), (2, {}), (3, None)], f"id int, tags {TAGS}")
    assert one(C.matching_rules(tagged, rules, "source_tags").select("id", "rule_id")) == [(1, 1)]
    hidden = spark.createDataFrame([(1, ["p*", "q"]), (2, []), (3, None)], "rule_id int, patterns array<string>")
    assert one(C.tag_filters(hidden)) == [(3, ""), (2, ""), (1, "p*")]


def test_a_new_table_is_loaded_in_one_pass(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(U, "durable", lambda df, what: written.append(what) or durable(df, what))
    path, shape = str(tmp_path / "t"), "p int, k int, v int"
    U.upsert_partitions(path, spark.createDataFrame([(1, 1, 10), (2, 1, 30)], shape), ["p", "k"], {"v": "replace"}, "p")
    assert written == []
    # a load may be made from the table itself
    own = spark.read.parquet(path).where("p = 2").select("p", "k", (F.col("v") * 3).cast("int").alias("v"))
    U.upsert_partitions(path, own, ["p", "k"], {"v": "replace"}, "p")
    assert len(written) == 1 and sorted((r["p"], r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1, 10), (2, 1, 90)]
