import os

import pytest

import corpus_pipeline

from .helpers import documents, odd, rows
from .test_decontaminate import plain as overlaps
from .test_line_templates import plain as without_lines
from .test_simhash import plain_similarity

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    passage = "the quick study of every kind of benchmark passage that may have leaked into a text of the corpus over many years of careful reading"
    body = [" ".join(f"word{i}x{j}" for j in range(60)) for i in range(12)]
    texts = body + [body[3], body[4].replace("word4x30", "other"), f"{body[0]} more {passage} and more", passage + " " + body[5]]
    df = odd(spark, clash=False).unionByName(documents(spark, texts, clash=False).selectExpr("doc_id + 100 as doc_id", "* except(doc_id)"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
    assert seen["quality_classifier"].count() == df.count()  # no limits without trusted texts
    before = rows(seen["quality_classifier"])
    assert sorted(map(str, without_lines([r["text"] for r in before], 5))) == sorted(str(r["text"]) for r in rows(seen["line_dedup"]))
    kept = rows(seen["simhash_near_dedup"])
    assert all(plain_similarity(a["text"] or "", b["text"] or "") < 0.8 for i, a in enumerate(kept) for b in kept[:i])
    clean = {r["doc_id"] for r in rows(seen["benchmark_decontamination"])}
    assert clean == {r["doc_id"] for r in kept if not overlaps(r["text"] or "", passage)}
    assert {r["doc_id"] for r in rows(seen["best_fit_packing"])} == clean


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
