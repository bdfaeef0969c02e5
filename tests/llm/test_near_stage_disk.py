"""Finding of round 3: disk of the pipeline's near-duplicate stage."""

from __future__ import annotations

from pathlib import Path

from llm_helpers import make_docs, prose  # noqa: F401


def test_the_near_stage_writes_no_copy_of_texts_met_once(spark, make_docs):
    import corpus_pipeline
    from dinerank.session import checkpoint_base

    texts = [prose(1000 + k, 3000) for k in range(60)]
    docs = make_docs([(k, t, "en") for k, t in enumerate(texts)] + [(100, texts[0], "en"), (None, texts[1], "en"), (101, texts[2] + " tail", "en")])
    base = Path(checkpoint_base(spark).removeprefix("file:"))
    before = {p for p in base.iterdir()}
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60))
    size = sum(f.stat().st_size for p in set(base.iterdir()) - before for f in p.rglob("*.parquet"))
    assert size < sum(map(len, texts)) / 4, size
