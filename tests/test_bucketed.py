"""The customer table from orders and line items stored by order key: same rows, no shuffle under their join."""

import re
import uuid

from churnlake.sources import bucketed
from churnlake.sources.customers import build_customers

SF = "/root/testdata/sf0.001"


def walk(node, under=False):
    """(first line of a node, whether below the order-key join) of a physical plan without adaptive wrapping."""
    text = node.toString().split("\n", 1)[0] if node.getClass().getSimpleName() not in ("InputAdapter", "WholeStageCodegenExec") else ""
    below = under or ("SortMergeJoin" in text and "l_orderkey" in text)
    yield text, below
    kids = node.children()
    for i in range(kids.size()):
        yield from walk(kids.apply(i), below)


def test_same_rows_and_no_exchange_under_the_join(spark):
    name = f"t_{uuid.uuid4().hex}"
    tables = bucketed.store_by_order(spark, SF, name, buckets=12)
    got = build_customers(spark, SF, tables)
    want = build_customers(spark, SF)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 0
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables too large to broadcast
    try:
        nodes = list(walk(build_customers(spark, SF, tables)._jdf.queryExecution().executedPlan()))
        plain = list(walk(build_customers(spark, SF)._jdf.queryExecution().executedPlan()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    below = [t for t, under in nodes if under]
    scans = [t for t in below if "Scan" in t]
    assert len(scans) == 2 and not any("Exchange" in t for t in below), below
    assert any("Exchange" in t for t, under in plain if under)  # without buckets both sides are shuffled


def test_buckets_follow_the_input_and_a_retry_replaces(spark):
    name = f"t_{uuid.uuid4().hex}"
    first = bucketed.store_by_order(spark, SF, name)
    n = first[1].count()
    again = bucketed.store_by_order(spark, SF, name)
    assert again[1].count() == n
    text = "\n".join(f"{r[0]} {r[1]}" for r in spark.sql(f"DESCRIBE EXTENDED {name}_lineitem").collect())
    assert re.search(r"Num Buckets 8\b", text) and "l_orderkey" in text


def test_a_bucket_holds_a_bounded_share_of_the_input():
    for gb in (1, 6, 60):
        assert (gb << 30) / bucketed.bucket_count(gb << 30) <= 32 << 20
    assert bucketed.bucket_count(0) == 8
