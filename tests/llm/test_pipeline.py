from __future__ import annotations

import zlib

import corpus_pipeline
from retail_engine.llm import stages
from retail_engine.llm.outliers import quality_rules

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, path = stage(spark, docs, SMALL), str(tmp_path / str(i))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if i < 4:
            assert out.columns == columns
            rows = out.collect()
            now = {r.doc_id for r in rows}
            assert now <= ids
            if name == "quality":
                kept = quality_rules(docs).where("kept").count()
                assert len(rows) == kept < docs.count()
            if name == "near_duplicates":
                assert len(rows) == len(now) and all(len(r.text) for r in rows)
            if name == "personal_data":
                assert now == ids and all(r.n_chars == len(r.text) for r in rows)
            ids = now
        docs = out
    assert {r.doc_id for r in docs.collect()} == ids
    # All of it once more gives the same pieces.
    digest = lambda df: sum(zlib.crc32(str(tuple(r)[:4]).encode()) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, SMALL)) == digest(docs)


def test_stages_keep_odd_rows_defined(odd, empty):
    assert {r.doc_id for r in stages.of_quality(odd).collect()} <= {5, 6, 7, None}
    kept = stages.without_near_duplicates(odd).collect()
    # 6, its copy and 7 are one; texts without words stay, each by itself.
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 2, 3, 4, 5, 6]
    assert stages.without_personal_data(odd, "key").count() == 10
    assert stages.at_target_weights(odd).columns == odd.columns
    for stage in (stages.of_quality, stages.without_near_duplicates, stages.at_target_weights):
        assert stage(empty).count() == 0
