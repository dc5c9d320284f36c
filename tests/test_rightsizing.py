"""Rightsizing: whole lists of fits, counts and recommendations against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from costloom.operators import rightsizing as R
from costloom.plans.registry import ORACLES, QUERIES

FLAGS = "architecture string, is_gpu boolean, is_confidential boolean, has_local_storage boolean, supports_premium boolean"
HARDWARE = f"cloud string, instance_type string, vcpu int, memory_gb double, baseline_iops double, throughput double, {FLAGS}"
PRICING = "cloud string, instance_type string, region string, os string, hourly_price double"
NEEDS = f"id long, provider string, region string, os string, need_vcpu double, need_ram double, need_iops double, need_net double, {FLAGS}"


@pytest.fixture(scope="module")
def fleet(spark):
    """Machines, types (few sizes, many of each) and prices, with nulls in every flag."""
    rng = random.Random(3)
    bit = lambda: rng.random() < 0.5
    hardware = [("aws", f"t{i:03}", rng.randint(1, 5), float(rng.randint(1, 4)), rng.choice([None, 100.0, 900.0]), rng.choice([None, 50.0]), rng.choice(["x86_64", "arm64", None]), rng.random() < 0.2, bit(), bit(), rng.choice([True, False, None])) for i in range(150)]
    pricing = [("aws", f"t{i:03}", region, "linux", float(rng.randint(0, 9))) for i in range(150) for region in "ab"]
    needs = [(i, "aws", rng.choice("abc"), "linux", float(rng.randint(1, 5)), float(rng.randint(1, 4)), rng.choice([0.0, 500.0]), rng.choice([0.0, 60.0]), rng.choice(["x86_64", "arm64", None]), rng.choice([True, False, None]), bit(), bit(), rng.choice([True, False, None])) for i in range(60)]
    return needs, hardware, pricing, spark.createDataFrame(needs, NEEDS), spark.createDataFrame(hardware, HARDWARE), spark.createDataFrame(pricing, PRICING)


def fits_of(needs, hardware, pricing, excluded):
    """(id, candidate, price, warnings) by loops."""
    own = {h[1]: h for h in hardware}
    for n in needs:
        for _, name, region, _, price in pricing:
            h = own[name]
            rooms = all(have is None or have >= need for have, need in zip(h[2:6], n[4:8]))
            if region != n[2] or price <= 0 or name.startswith(excluded) or not rooms or h[7] != n[9]:
                continue
            found = ["architecture"] if None not in (h[6], n[8]) and h[6] != n[8] else []
            found += [w for w, have, has in zip(R.WARNING_NAMES[1:], h[8:], n[10:]) if has and have is False]
            yield n[0], name, price, tuple(sorted(found))


def test_all_fits_are_listed(spark, fleet):
    needs, hardware, pricing, n, h, p = fleet
    want = sorted(fits_of(needs, hardware, pricing, "t00"))
    for salts in (1, 8):
        got = R.vm_candidates(n, h, p, F.array(F.lit("t00*")), salts=salts).collect()
        assert sorted((r["id"], r["candidate"], r["candidate_price"], tuple(r["warnings"])) for r in got) == want


def test_fits_are_made_from_blocks_of_equal_offers(spark, fleet):
    needs, hardware, pricing, n, h, p = fleet
    want = sorted(fits_of(needs, hardware, pricing, "t00"))
    offers = R.offers_of(h, p, F.array(F.lit("t00*")))
    for most in (1, 2, 1000):
        got = R.listed_fits(n, offers, most=most).collect()
        assert sorted((r["id"], r["candidate"], r["candidate_price"], tuple(r["warnings"])) for r in got) == want
        sizes = R.offer_blocks(offers, most).agg(F.sum(F.size("__types")), F.max(F.size("__types"))).first()
        assert sizes[0] == offers.count() and sizes[1] <= most
    # children stand below their parents: warnings and prices are found before the fits of a block are made
    plan = QUERIES["vm_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("array_join") and plan.index("Generate inline") < plan.index("round(")


def test_an_offers_rows_come_one_after_another(spark):
    flags = ("x86_64", False, False, False, False)
    hardware = [("aws", f"t{i:03}", 4, 8.0, None, None, *flags) for i in range(30)]
    needs = [(i, "aws", "a", "linux", 1.0 + i % 5, 1.0, 0.0, 0.0, *flags) for i in range(200)]
    n, h = spark.createDataFrame(needs, NEEDS), spark.createDataFrame(hardware, HARDWARE)
    p = spark.createDataFrame([("aws", f"t{i:03}", "a", "linux", 1.0 + i) for i in range(30)], PRICING)
    got = [(r["candidate"], r["id"]) for r in R.vm_candidates(n, h, p, salts=1).collect()]
    assert sorted(got) == [(f"t{i:03}", m) for i in range(30) for m in range(200) if m % 5 < 4]
    # files hold a name and its price once for many ids
    assert sum(a[0] != b[0] for a, b in zip(got, got[1:])) < 100


def test_offers_are_not_copied_to_meet_machines(spark, fleet):
    *_, n, h, p = fleet
    lines = R.vm_candidates(n, F.broadcast(h), p)._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    side = lines[at + 1].index(":-")
    end = next(i for i, x in enumerate(lines) if i > at and x[side] == "+")
    offers, machines = lines[at + 1 : end], lines[end:]
    assert any("hourly_price" in x for x in offers) and not any("hourly_price" in x for x in machines)
    # shuffled to be numbered and to be met; only machines are copied to every part
    assert sum("Exchange hashpartitioning" in x for x in offers) == 2 and not any("explode" in x for x in offers)
    assert sum("Generate explode" in x for x in machines) == 1


def test_machines_of_few_kinds_are_dealt_out_by_ranges(spark, fleet):
    needs, _, _, n, _, _ = fleet
    for most in (1, 4, 1000):
        got = [(r, m) for r in R.machine_blocks(n, most).collect() for m in r["__machines"]]
        assert sorted(m["id"] for _, m in got) == [x[0] for x in needs]
        assert all(needs[m["id"]] == (m["id"], *(r[k] for k in R.KEY), *(m[k] for k in R.NEEDS), *(r[k] for k in R.FLAGS)) for r, m in got)
        assert max(len(r["__machines"]) for r, _ in got) <= most
    plan = R.machine_blocks(n)._jdf.queryExecution().executedPlan().toString()
    # grouped where ranges have dealt them out, so no task takes all machines of a kind
    assert "Window" not in plan and plan.rindex("ObjectHashAggregate") < plan.index("Exchange rangepartitioning")


def test_no_cut_in_the_registered_lists(spark):
    rows = QUERIES["vm_candidates"](spark, "/root/testdata/sf0.001")
    assert rows.groupBy("id").count().agg(F.max("count")).first()[0] > 10
    assert "position <=" not in ORACLES["vm_candidates"]


def test_warnings_are_counted_over_all_fits(spark, fleet):
    needs, hardware, pricing, n, h, p = fleet
    want = {}
    for *_, found in fits_of(needs, hardware, pricing, "t00"):
        want[found] = want.get(found, 0) + 1
    got = R.warning_counts(n, h, p, F.array(F.lit("t00*"))).collect()
    assert {tuple(r["warnings"]): r["n"] for r in got} == want and len(got) == len(want)
    few = "/root/testdata/sf0.001"
    total = QUERIES["vm_candidate_warnings"](spark, few).agg(F.sum("n")).first()[0]
    assert total == QUERIES["vm_candidates"](spark, few).count() and "position <=" not in ORACLES["vm_candidate_warnings"]


def test_prices_are_grouped_after_they_are_dealt_out(spark):
    from costloom.operators.upsert import pricing_dedupe

    rows = spark.createDataFrame([("aws", "t1", "a", "linux", 2.0), ("aws", "t1", "a", "linux", 1.0), ("aws", "t2", "a", "linux", 3.0)], PRICING)
    out = pricing_dedupe(rows)
    assert sorted(tuple(r) for r in out.collect()) == [("aws", "t1", "a", "linux", 1.0), ("aws", "t2", "a", "linux", 3.0)]
    # children stand below their parents: no grouping below the only exchange
    plan = pricing_dedupe(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")


def test_the_cheapest_fits_of_every_machine(spark, fleet):
    needs, hardware, pricing, n, h, p = fleet
    limits = {i: [None, 0.0, 4.0, 8.0][i % 4] for i, *_ in needs}
    want = set()
    for i, limit in limits.items():
        seen = {}
        for _, name, price, found in sorted((x for x in fits_of(needs, hardware, pricing, "t00") if x[0] == i), key=lambda x: (x[2], x[1])):
            if () not in seen and found not in seen and (not limit or price < limit):
                seen[found] = (i, name, price, found)
        want |= set(seen.values())
    prices = spark.createDataFrame(list(limits.items()), "id long, price double")
    offers = R.offers_of(h, p, F.array(F.lit("t00*")))
    got = R.cheapest(n.join(prices, "id").select("id", *R.ASKED, "price"), offers).collect()
    assert {(r["id"], r["candidate"], r["candidate_price"], tuple(r["warnings"])) for r in got} == want and len(got) == len(want)


def test_a_frontier_is_made_of_sizes_and_not_of_types(spark, fleet):
    *_, h, p = fleet
    plan = R.skyband(R.offers_of(h, p), [*R.KEY, *["c_" + f for f in R.FLAGS]])._jdf.queryExecution().executedPlan().toString()
    # equal sizes are thinned out by Spark before the Python groups
    assert plan.index("FlatMapGroupsIn") < plan.index("WindowGroupLimit")
