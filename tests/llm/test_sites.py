"""Operator 8: documents meet their sites alike, whether all, some or no sites are broadcast."""

from pyspark.sql import functions as F

from quarry.llm import quality


def test_few_and_many_sites_decide_alike(spark):
    rows = [(k, ["the good text of a page, as it is.", "@@ ## buy 11 buy", "", None][k % 4], f"h{k % 3 if k < 200 else k}", "p" if k % 5 else None, "x", k) for k in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _n string, n long").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    want = {r["doc_id"] for r in quality.classify(docs, model).filter("kept").collect()}
    assert 0 < len(want) < 260
    for few in (1, 7, 1 << 14):
        kept = quality.keep_good(docs, model, few=few)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert quality.keep_good(docs.filter(F.col("doc_id") < 0), model, few=1).count() == 0
