import tempfile

from churnlake.plans import base
from churnlake.streaming.scoring import start_scoring

SF = "/root/testdata/sf0.001"


def test_stream_scoring_matches_batch(spark):
    tr, te = base.train_test(spark, SF)
    src = tempfile.mkdtemp(prefix="churnlake-stream-src-")
    sink = tempfile.mkdtemp(prefix="churnlake-stream-sink-")
    te.repartition(3).write.mode("overwrite").parquet(src)
    q = start_scoring(spark, src, tr, sink, name=f"t{abs(hash(sink))}")
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == te.count()
    batch = {r["customer_id"]: r["churn_probability"] for r in base.reference_scores(te).collect()}
    for r in out.select("customer_id", "churn_probability", "status").collect():
        assert abs(r["churn_probability"] - batch[r["customer_id"]]) < 1e-12
        assert r["status"] in ("At Risk", "Monitoring", "Healthy")
