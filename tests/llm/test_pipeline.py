"""The corpus pipeline on a small table."""

import corpus_pipeline
from churnlake.llm import decontam, jaccard, langid, linededup, mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        counts.append(docs.count())
        assert docs.columns[:len(columns)] == columns
        if name == "language_id":
            gone = before.join(docs, "doc_id", "left_anti").join(langid.label(before), "doc_id")
            assert gone.where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SCORE}").count() == 0
        elif name == "line_dedup":
            assert docs.join(linededup.dedup(before).select("doc_id", "text"), ["doc_id", "text"]).count() == docs.count()
        elif name == "ngram_jaccard":
            assert docs.count() == before.join(jaccard.classes(before), "doc_id").select("component_id").distinct().count()
        elif name == "decontaminate":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontam.decontaminate(docs, bench).where("contaminated").count() == 0
            assert docs.count() == decontam.decontaminate(before, bench).where("not contaminated").count()
        else:
            assert docs.count() == mixing.allocate(before).groupBy().sum("copies").first()[0]
    assert counts[1] >= 0.95 * counts[0] and counts[2] >= 0.95 * counts[1] and counts[3] < counts[2]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
