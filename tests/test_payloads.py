"""Payloads of the stand-in tables hold a bounded number of rows."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from costloom.plans import other_queries as Q
from costloom.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = "prom_matrix_points azure_metric_points aws_metric_points azure_sku_hardware aws_type_hardware azure_price_rows aws_price_rows krr_scan_rows".split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_payloads_grow_in_number_and_not_in_size(spark, monkeypatch, name):
    def run():
        if name != "krr_scan_rows":
            return QUERIES[name](spark, FOLDER)
        # the smallest tables have one supplier in most nations
        return Q.krr_scan_rows(SimpleNamespace(supplier=spark.range(40).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "id % 2 AS s_nationkey")))

    whole, seen = sorted(map(repr, run().collect())), []
    operator = getattr(Q.P, name)

    def watched(payloads):
        seen.append(payloads.agg(F.count(F.lit(1)), F.max(F.length("payload"))).first())
        return operator(payloads)

    monkeypatch.setattr(Q.P, name, watched)
    for rows in (10**9, 5):
        monkeypatch.setattr(Q, "PAYLOAD_ROWS", rows)
        assert sorted(map(repr, run().collect())) == whole
    assert seen[1][0] > seen[0][0] and seen[1][1] < seen[0][1]
