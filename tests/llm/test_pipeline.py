"""The pipeline's stages on a small corpus, each against a plain version on its own input."""

from __future__ import annotations

import corpus_pipeline
from swathlab.llm import language

from .test_operators import reference_pairs, similar_roots


def test_stages(spark, awkward, tmp_path):
    sf = str(tmp_path)
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{sf}/documents.parquet")
    passage = docs.where("doc_id = 3").first()["text"]
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near-dedup", "decontamination", "mixing", "sharding"]
    out = {}
    for name, stage in stages.items():
        out[name] = stage(spark, docs, sf)
        out[name].write.parquet(f"{sf}/{name}")
        before, docs = docs, spark.read.parquet(f"{sf}/{name}")
        rows, kept = before.collect(), docs.collect()
        if name != "sharding":
            assert docs.columns == before.columns
        if name == "language":
            given = tuple(sorted(language.fit_dictionaries(before).items()))
            assert sorted(r["text"] for r in kept) == sorted(r["text"] for r in rows if not language.classify(r["text"], given)[2])
        if name == "near-dedup":
            roots = similar_roots([r["text"] for r in rows])
            assert sorted(r["text"] for r in kept) == sorted(min((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in rows if roots[r["text"]] == root)[2] for root in set(roots.values()))
        if name == "decontamination":
            bad = {d for d, *_ in reference_pairs([(r["doc_id"], r["text"]) for r in rows], [(0, passage)])}
            assert {r["doc_id"] for r in rows} - {r["doc_id"] for r in kept} == bad == {3}
        if name == "sharding":
            assert len(kept) == len(rows) and {"shard", "slot"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
