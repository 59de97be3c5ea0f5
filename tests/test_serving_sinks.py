import tempfile

from pyspark.sql import functions as F

from churnlake.operators import segments as seg
from churnlake.operators import serving as sv
from churnlake.operators.ranking import keyset_page, top_n
from churnlake.sources import sinks
from churnlake.sources.tables import read_document, read_table, source_or_fallback


def _dir(spark):
    rows = [(f"CUST{100000 + i}", 0.01 * i, 1000.0 + i, 5 + i) for i in range(40)]
    scores = spark.createDataFrame([(r[0], int(r[1] >= 0.5), r[1]) for r in rows],
                                   "customer_id string, churn_prediction int, churn_probability double")
    test = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows],
                                 "customer_id string, estimated_clv_usd double, tenure_months int")
    return sv.customer_directory(scores, test)


def test_directory_status_and_search_is_literal(spark):
    d = _dir(spark)
    rows = d.collect()
    assert [r["churn_probability"] for r in rows] == sorted((r["churn_probability"] for r in rows), reverse=True)
    for r in rows:
        assert r["status"] in ("At Risk", "Monitoring", "Healthy")
    assert sv.search_customers(d, "%", "All").count() == 0     # % is not a wildcard
    assert sv.search_customers(d, "cust10001", "All").count() == 10
    assert sv.search_customers(d, "", "Healthy").count() == d.filter(F.col("status") == "Healthy").count()


def test_keyset_pages_cover_everything_once(spark):
    d = _dir(spark)
    seen, after = [], None
    while True:
        page = keyset_page(d, "churn_probability", "id", after, 15).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = (page[-1]["churn_probability"], page[-1]["id"])
    assert len(seen) == 40 and len(set(seen)) == 40


def test_risk_segments_keep_empty_bands(spark):
    s = spark.createDataFrame([(0.9,), (0.95,), (0.1,)], "churn_probability double")
    got = {r["name"]: r["value"] for r in seg.risk_segments(s).collect()}
    assert got == {"High Risk": 2, "Medium Risk": 0, "Low Risk": 1}
    p = spark.createDataFrame([(1,), (0,)] * 10, "churn_prediction int")
    fb = {r["name"]: r["value"] for r in seg.risk_segments(p).collect()}
    assert fb == {"High Risk": 10, "Medium Risk": 3, "Low Risk": 7}


def test_top_n_ranks(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0)], "k string, v double")
    r = top_n(df, [F.col("v").desc(), F.col("k")], 2).collect()
    assert [(x["k"], x["rank"]) for x in r] == [("a", 1), ("b", 2)]


def test_csv_and_document_round_trip(spark):
    base = tempfile.mkdtemp(prefix="churnlake-io-")
    df = spark.createDataFrame([("x", 1, 2.5), ("y", None, None)], "a string, b int, c double")
    sinks.write_csv(df, f"{base}/csv")
    back = read_table(spark, f"{base}/csv", "csv", "a string, b int, c double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    doc = spark.createDataFrame([(3, "m")], "n int, name string")
    sinks.write_document(doc, f"{base}/doc")
    r = read_document(spark, f"{base}/doc").head()
    assert r["n"] == 3 and r["name"] == "m"
    got = source_or_fallback(spark, f"{base}/missing", lambda: doc, lambda: df)
    assert got.columns == df.columns


def test_the_document_is_worked_out_once_for_its_parts(spark, tmp_path):
    from pyspark.sql import functions as F

    from churnlake.sources import sinks
    runs = spark.sparkContext.accumulator(0)

    def said(n):
        runs.add(1)
        return f'{{"n":{n}}}'

    doc = spark.range(3).agg(F.count(F.lit(1)).alias("n")).select(F.udf(said)("n").alias("json"))
    rows = spark.range(50).select(F.col("id").alias("row"), F.format_string("c%d", "id").alias("name"))
    sinks.write_document_rows(doc, "all", rows, "row", f"{tmp_path}/doc")
    assert runs.value == 1
    assert sinks.read_document_rows(spark, f"{tmp_path}/doc", "name string").count() == 50
