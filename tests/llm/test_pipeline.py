import corpus_pipeline as C
from lakequill.llm import jaccard, quality_rules, secrets
from lakequill.llm.common import materialize, table
from tests.llm.fixtures import docs
from tests.llm.test_jaccard import brute


def test_stages_on_given_tables(spark, sf):
    d = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    texts, sizes = {}, []
    for name, stage in C.STAGES:
        before, d = d, materialize(stage(spark, d, sf))
        rows = d.collect()
        sizes.append(len(rows))
        if name != "packing":
            assert d.columns == before.columns and d.dtypes == before.dtypes
        if name == "quality_rules":
            kept = {r.doc_id for r in rows}
            good = [i for i, q in quality.items() if q]
            fine = {r.doc_id for r in quality_rules.op8(before, labels).where("not base_failed").collect()}
            assert kept <= fine
            assert sum(i in kept for i in good if i in fine) >= 0.99 * sum(i in fine for i in good)
        if name == "near_duplicates":
            base = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in rows) == sorted(i for i, _, c in brute(base, 5, 80, 100) if i == c)
        if name == "secrets":
            assert secrets.op3(d).where("n_assign + n_access + n_hex > 0").count() == 0
            texts = {r.doc_id: r.text for r in rows}
        if name == "mix":
            assert all(texts[r.doc_id] == r.text for r in rows)
    assert all(sizes)


def test_run_with_null_columns(spark, tmp_path):
    sf = str(tmp_path)
    d = docs(spark)
    d.drop("score", "labels").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert C.run(spark, sf).count() > 0
    for _, stage in C.STAGES:
        assert stage(spark, d.limit(0), sf).count() == 0
    assert jaccard.keep_one(d).columns == d.columns
