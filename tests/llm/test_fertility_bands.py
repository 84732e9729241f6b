"""Fertility bands against labels."""

from nameshift.llm import queries


def test_bands_reject_most_labelled_outliers_and_keep_clean_texts(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op3_fertility_rules"](spark, folder).where("NOT base_failed")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").max("quality").toDF("doc_id", "quality")
    rows = got.join(labels, "doc_id").select("quality", "kept", "n_pieces").collect()
    share = lambda q, least=0: sum(r.kept for r in rows if r.quality == q and r.n_pieces >= least) / sum(r.quality == q and r.n_pieces >= least for r in rows)
    print({(q, k): sum((r.quality, r.kept) == (q, k) for r in rows) for q in (0, 1) for k in (True, False)})
    assert share(0) < 0.4 and share(0, 1024) < 0.25
    assert share(1) > 0.995
    for low in range(6, 12):  # clean texts of each length
        clean = [r.kept for r in rows if r.quality == 1 and 1 << low <= r.n_pieces < 2 << low]
        assert sum(clean) >= 0.98 * len(clean)
