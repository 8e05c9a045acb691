"""The pipeline's stages on the smallest tables: what each keeps, and their chain."""

import corpus_pipeline
from cuelight.llm import line_quality, ngram_join

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if k < 4:
            assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    kept = {r.doc_id for r in line_quality.line_quality(docs, labels).where("kept").collect()}
    assert ids[1] == kept
    left = ngram_join.ngram_components(seen[2], 5, 80).collect()
    assert ids[3] == {r.component_id for r in left if r.n_shingles} | {r.doc_id for r in left if not r.n_shingles}
    assert ids[4] == ids[3] == ids[5] and seen[5].count() == seen[4].count() >= len(ids[3])
