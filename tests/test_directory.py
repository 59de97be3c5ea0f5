"""The stored directory: pages, search and document rows against the plain operators and Python, and what the plans read."""

import glob
import json
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from churnlake.operators import directory as di
from churnlake.operators import serving as sv
from churnlake.operators.ranking import keyset_page
from churnlake.sources import sinks

N, GROUP = 100_000, 1_000


def make(spark, n):
    """Scores with many ties, a few null scores and ids."""
    return spark.range(n).select(
        F.when(F.col("id") % 9973 != 5, F.concat(F.lit("CUST"), (F.col("id") * 7919 % 1_000_003).cast("string"))).alias("id"),
        (F.col("id") % 100).cast("int").alias("clv"),
        F.element_at(F.array(F.lit("At Risk"), F.lit('Mon"it,or\n')), (F.col("id") % 2 + 1).cast("int")).alias("status"),
        F.when(F.col("id") % 8000 != 7, F.round(F.col("id") * 31 % 4096 / 4096.0, 3)).alias("churn_probability"))


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small sorts stay in several partitions, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def stored(spark, many_parts):
    plain = make(spark, N).repartition(16)
    d = di.store(plain, tempfile.mkdtemp(prefix="churnlake-dir-"), GROUP)
    rows = [tuple(r) for r in plain.collect()]
    key = lambda r: (r[3] is None, -(r[3] or 0), r[0] is None, r[0] or "")
    return d, sorted(rows, key=key), key


def rows_of(df):
    return [tuple(r)[:4] for r in df.collect()]


def test_order_positions_and_fences(stored):
    d, want, key = stored
    got = rows_of(d.rows.orderBy("row"))
    assert [key(r) for r in got] == [key(r) for r in want]
    assert len(glob.glob(f"{d.path}/rows/part-*")) > 1
    place = {r["row"]: i for i, r in enumerate(d.rows.orderBy("row").select("row").collect())}
    fences = d.table("fences").collect()
    assert fences and all(place[f["row"]] == f["position"] for f in fences)


@pytest.mark.parametrize("size,number", [(15, 0), (15, 1), (15, 3333), (15, 6666), (15, 6667), (2500, 3), (15, 10_000)])
def test_pages_by_number(stored, size, number):
    d, want, key = stored
    got = rows_of(di.page(d, number, size))
    assert [key(r) for r in got] == [key(r) for r in want[number * size:(number + 1) * size]]


def test_pages_by_key(stored, spark):
    d, want, key = stored
    named = [r for r in want if r[0] is not None and r[3] is not None]
    for after in [None, named[0], named[14], named[50_000], named[-1], ("CUST5", 0, "", 0.5), ("", 0, "", 2.0), ("zz", 0, "", -1.0)]:
        k = None if after is None else (after[3], after[0])
        behind = [r for r in want if k is None or key(r) > key(after)][:15]
        assert [key(r) for r in rows_of(di.page_after(d, k, 15))] == [key(r) for r in behind], after


def read_rows(df):
    """Rows that the scans below a query gave out after footer pruning."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_a_page_reads_few_row_groups(stored):
    d, _, _ = stored
    for df in (di.page(d, 4000, 15), di.page_after(d, (0.4, "CUST5"), 15)):
        read = read_rows(df)
        assert 15 <= read <= 8 * GROUP, read


@pytest.mark.parametrize("term,status", [("T7919", "All"), ("cust99", "At Risk"), ("t risk", "All"), ("risk", "At Risk"), ("12345", "All"), ("99", "All"), ("", "All"),
                                         ("CUST", "At Risk"), ("%_%", "All"), ("nowhere", "All"), ('N"I', "All")])
def test_search_equals_the_scan(stored, term, status):
    d, _, _ = stored
    want = rows_of(sv.search_customers(d.rows, term, status))
    assert sorted(map(repr, rows_of(di.search(d, term, status)))) == sorted(map(repr, want))


def test_search_reads_one_gram(stored):
    d, _, _ = stored
    df = di.search(d, "71234", "All")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(gram,", plan) and "Exchange" not in plan
    rarest = min((r["n"], r["gram"]) for r in d.table("grams").filter(F.col("gram").isin("712", "123", "234")).collect())
    hits = d.table("postings").filter(F.col("gram") == rarest[1])
    assert hits.count() == rarest[0]
    assert read_rows(hits) <= rarest[0] + 8 * GROUP


def parts(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_document_round_trip(stored, spark):
    d, want, key = stored
    path = tempfile.mkdtemp(prefix="churnlake-doc-")
    doc = spark.createDataFrame([('{"kpis":[{"n":1}]}',)], "json string")
    sinks.write_document_rows(doc, "customers", d.rows, "row", path)
    assert len(glob.glob(f"{path}/part-*")) > 1  # written in parallel
    whole = json.loads(parts(path))
    assert whole["kpis"] == [{"n": 1}]
    assert [(r["id"], r["clv"], r["status"], r["churn_probability"]) for r in whole["customers"]] == rows_of(d.rows.orderBy("row"))
    back = sinks.read_document_rows(spark, path, d.rows.drop("row").schema)
    assert back.exceptAll(d.rows.drop("row")).count() == 0 and back.count() == N


def test_empty_directory(spark):
    d = di.store(make(spark, 0), tempfile.mkdtemp(prefix="churnlake-dir-"))
    assert di.page(d, 0, 15).count() == di.page_after(d, (0.5, "a"), 15).count() == di.search(d, "cust").count() == di.search(d, "c").count() == 0
    path = tempfile.mkdtemp(prefix="churnlake-doc-")
    sinks.write_document_rows(spark.createDataFrame([('{"a":1}',)], "json string"), "customers", d.rows, "row", path)
    assert json.loads(parts(path)) == {"a": 1, "customers": []}
