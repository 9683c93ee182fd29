"""A score means the same however few of the labels are sampled."""

from secondlook.llm import compression

SF = "/root/testdata/sf0.1"


def test_scores_keep_the_class_prior_of_all_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    model = compression.fit(docs, labels, sample_rows=200)  # as many bad rows as good ones, of a sixth of the labels
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id")
    rows = compression.score(good, model, 0.7).join(docs.selectExpr("doc_id", "octet_length(text) AS size"), "doc_id").collect()
    rejected = lambda own: sum(not r.predicted for r in own) / len(own)
    assert rejected(rows) < 0.03 and rejected([r for r in rows if r["size"] >= 3_000]) < 0.03
