"""Closures kept up to date, tag joins through rare tags, and Pareto frontiers, against rebuilds and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from costloom.operators import hierarchy as H
from costloom.operators import rightsizing as R
from costloom.operators import tagjoin as T
from costloom.operators.upsert import snapshots

TAGS = "map<string,string>"


def pairs(df):
    return sorted((r["ancestor"], r["descendant"], r["depth"], tuple(r["path"])) for r in df.collect())


def node_rows(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id long, parent_id long")


@pytest.mark.parametrize("seed", range(4))
def test_a_closure_after_moves_is_the_rebuilt_one(spark, seed):
    rng = random.Random(seed)
    parents = {0: None} | {i: rng.randrange(max(0, i - 5), i) for i in range(1, 25)}
    tree = H.closure(node_rows(spark, parents))

    def above(i, tops):
        while i is not None:
            if i in tops:
                return True
            i = parents.get(i)
        return False

    for step in range(2):
        changes = {}
        for i in rng.sample(sorted(parents), 5):
            free = [j for j in parents if not above(j, {i})]
            if i and free:
                parents[i] = changes[i] = rng.choice([*free, None])
        for i in range(3):
            new = 100 * (step + 1) + i
            parents[new] = changes[new] = rng.choice([*sorted(parents), 999])
        tree = H.moved_closure(tree, node_rows(spark, changes))
        assert pairs(tree) == pairs(H.closure(node_rows(spark, parents)))


def test_moves_into_the_own_subtree_are_an_error(spark):
    tree = H.closure(node_rows(spark, {0: None, 1: 0, 2: 1, 3: 2}))
    with pytest.raises(ValueError):
        H.moved_closure(tree, node_rows(spark, {1: 3}))
    with pytest.raises(ValueError):
        H.moved_closure(tree, node_rows(spark, {1: 7, 7: 8, 8: 7}))
    assert pairs(H.moved_closure(tree, node_rows(spark, {1: 0}).limit(0))) == pairs(tree)


def test_a_stored_closure_follows_its_entities(spark, tmp_path):
    folder = str(tmp_path / "closure")
    parents = {0: None, 1: 0, 2: 1, 3: 1, 4: 2}
    for change, written in (({}, 1), ({}, 1), ({2: 0, 9: 4}, 2), ({3: 9}, 3)):
        parents |= change
        assert pairs(H.stored_closure(node_rows(spark, parents), folder)) == pairs(H.closure(node_rows(spark, parents)))
        # a snapshot for each change, of which the last two stay
        assert snapshots(spark, f"{folder}/pairs") == list(range(max(1, written - 1), written + 1))
    del parents[3]
    assert pairs(H.stored_closure(node_rows(spark, parents), folder)) == pairs(H.closure(node_rows(spark, parents)))


def test_rules_are_met_through_their_rarest_tag(spark):
    rng = random.Random(1)
    rows = [(i, {"all": "x", "half": str(i % 2), **({"rare": str(i)} if i % 10 == 0 else {})}) for i in range(400)] + [(900, {}), (901, None)]
    rules = [(f"r{i}", {"all": "x", "rare": str(10 * i)}) for i in range(30)] + [("h", {"half": "1", "all": "x"}), ("none", {"all": "x", "half": "7"}), ("empty", {}), ("null", None), ("again", {"rare": "10", "all": "x"})]
    rng.shuffle(rows)
    tagged = spark.createDataFrame(rows, f"id long, tags {TAGS}").repartition(3)
    asked = spark.createDataFrame(rules, f"rule string, wanted {TAGS}")
    want = sorted((i, r) for i, t in rows for r, w in rules if t and w and w.items() <= t.items())
    for hot in (T.HOT_ROWS, 7):
        assert sorted(tuple(r) for r in T.containing(tagged, asked, "wanted", hot_rows=hot).select("id", "rule").collect()) == want
        # all hold the common tag, but no row meets a rule through it
        assert T.candidates(tagged, asked, "wanted", hot_rows=hot).count() == len(want)
    assert T.containing(tagged, asked.limit(0), "wanted").count() == 0 and T.containing(tagged.limit(0), asked, "wanted").count() == 0
    with pytest.raises(ValueError):
        T.containing(tagged, asked.withColumnRenamed("rule", "id"), "wanted")


@pytest.mark.parametrize("k", [1, 3])
def test_the_best_fits_lie_in_the_band(spark, k):
    rng = random.Random(k)
    hardware = [("aws", f"t{i:03}", rng.randint(1, 8), float(rng.randint(1, 32)), rng.choice([None, 100.0, 900.0]), rng.choice([None, 50.0]), rng.choice(["x86_64", "arm64"]), rng.random() < 0.2, rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5) for i in range(120)]
    pricing = [("aws", f"t{i:03}", region, "linux", float(rng.randint(0, 15))) for i in range(120) for region in "ab"]
    flags = ["x86_64", "arm64", None]
    needs = [(i, "aws", rng.choice("abc"), "linux", float(rng.randint(1, 9)), float(rng.randint(1, 30)), rng.choice([0.0, 500.0]), rng.choice([0.0, 60.0]), rng.choice(flags), rng.choice([True, False, None]), *[rng.choice([True, False]) for _ in range(3)]) for i in range(50)]
    h = spark.createDataFrame(hardware, "cloud string, instance_type string, vcpu int, memory_gb double, baseline_iops double, throughput double, architecture string, is_gpu boolean, is_confidential boolean, has_local_storage boolean, supports_premium boolean")
    p = spark.createDataFrame(pricing, "cloud string, instance_type string, region string, os string, hourly_price double")
    n = spark.createDataFrame(needs, "id long, provider string, region string, os string, need_vcpu double, need_ram double, need_iops double, need_net double, architecture string, is_gpu boolean, is_confidential boolean, has_local_storage boolean, supports_premium boolean")
    every = R.vm_candidates(n, h, p, F.array(F.lit("t00*")))
    want = {}
    for r in every.collect():
        want.setdefault(r["id"], []).append((r["candidate_price"], r["candidate"], tuple(r["warnings"])))
    want = {(i, pos + 1, *x) for i, found in want.items() for pos, x in enumerate(sorted(found)[:k])}
    got = R.best_candidates(n, h, p, F.array(F.lit("t00*")), k=k).collect()
    assert {(r["id"], r["position"], r["candidate_price"], r["candidate"], tuple(r["warnings"])) for r in got} == want and len(got) == len(want)
    offers = R.offers_of(h, p)
    assert R.skyband(offers, [*R.KEY, "c_is_gpu"], k).count() < offers.count()


def test_retention_leaves_kept_days_alone(spark, tmp_path):
    import datetime as dt

    from costloom.operators import retention as Z

    path = str(tmp_path / "t")
    rows = [(i, dt.datetime(2024, 1, d, h)) for i, (d, h) in enumerate([(1, 3), (2, 5), (3, 6), (3, 18), (4, 1), (5, 2)])] + [(9, None)]
    spark.createDataFrame(rows, "id int, ts timestamp").withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    kept = {p: p.stat().st_mtime_ns for d in ("2024-01-04", "2024-01-05", "__HIVE_DEFAULT_PARTITION__") for p in (tmp_path / "t" / f"day={d}").glob("*.parquet")}
    cutoff = dt.datetime(2024, 1, 3, 12)
    assert Z.drop_before(spark, path, "day", "ts", cutoff) == {"gone": ["2024-01-01", "2024-01-02"], "rewritten": ["2024-01-03"]}
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4, 5, 9]
    assert Z.drop_before(spark, path, "day", "ts", cutoff)["gone"] == []
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    assert Z.drop_before(spark, path, "day", "ts", dt.datetime(2024, 1, 5))["gone"] == ["2024-01-03", "2024-01-04"]
    assert Z.drop_before(spark, path, "day", "ts", dt.datetime(2024, 1, 5, 9))["gone"] == ["2024-01-05"]


def test_old_snapshots_go(spark, tmp_path):
    from costloom.operators.upsert import current, expire, publish

    folder = str(tmp_path / "s")
    for n in range(4):
        publish(spark.range(n + 1), folder)
    assert expire(spark, folder, keep=2) == [1, 2] and snapshots(spark, folder) == [3, 4] and current(spark, folder).count() == 4


def test_the_network_capacity_is_a_choice(spark):
    flags = "architecture string, is_gpu boolean, is_confidential boolean, has_local_storage boolean, supports_premium boolean"
    rest = ("x86_64", False, False, False, True)
    h = spark.createDataFrame([("aws", "a", 4, 8.0, None, 10.0, 1000.0, *rest), ("aws", "b", 4, 8.0, None, None, 100.0, *rest)], f"cloud string, instance_type string, vcpu int, memory_gb double, baseline_iops double, throughput double, network_mbps double, {flags}")
    p = spark.createDataFrame([("aws", "a", "r", "linux", 2.0), ("aws", "b", "r", "linux", 1.0)], "cloud string, instance_type string, region string, os string, hourly_price double")
    n = spark.createDataFrame([(1, "aws", "r", "linux", 1.0, 1.0, 0.0, 500.0, *rest)], f"id long, provider string, region string, os string, need_vcpu double, need_ram double, need_iops double, need_net double, {flags}")
    for column, best in (("throughput", "b"), ("network_mbps", "a")):
        assert [r["candidate"] for r in R.best_candidates(n, h, p, net_capacity=column).collect()] == [best]
