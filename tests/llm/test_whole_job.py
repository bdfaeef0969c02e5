"""Cases in which an operator once did less than its whole job."""

import random
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
from llm_helpers import make_docs, no_docs, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from dinerank.llm import decontamination, language_id, near_dedup, token_counts, toxicity


def test_a_language_of_one_row_in_five_thousand_is_learned(make_docs):
    r = random.Random(12)
    kinds = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "rr": "mnopqrst"}

    def text(lang):
        return " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randint(2, 6))) for _ in range(20))

    rows = [(i, text("rr" if i % 5000 == 0 else "aabbcc"[i % 3 * 2:][:2])) for i in range(20_000)]
    langs = ["rr" if i % 5000 == 0 else "aabbcc"[i % 3 * 2:][:2] for i in range(20_000)]
    docs = make_docs([(i, t, k) for (i, t), k in zip(rows, langs, strict=True)])
    params = language_id.LanguageParams()
    sample = language_id.training_sample(docs, F.lit(True), params)
    assert sorted(x["text"] for x in sample if x["lang"] == "rr") == sorted(t for (_, t), k in zip(rows, langs, strict=True) if k == "rr")
    assert params.sample_texts <= len(sample) <= params.sample_texts + 4 * params.least_texts
    model = language_id.fit([x["text"] for x in sample], [x["lang"] for x in sample], params)
    for lang in kinds:
        best, _ = model.predict(pa.array([text(lang) for _ in range(60)], pa.large_string()))
        assert np.mean([model.languages[b] == lang for b in best]) > 0.9


def test_every_language_keeps_its_least_hashes(make_docs):
    rows = [(i, prose(i, 4), f"l{i % 40 if i % 7 == 0 else 0}") for i in range(3000)]
    docs = make_docs(rows + rows[:500])
    params = language_id.LanguageParams(sample_texts=50, least_texts=3)
    got = {x["_k"] for x in language_id.training_sample(docs, F.lit(True), params)}
    keys = docs.select("lang", F.xxhash64("text", "lang").alias("k")).distinct().collect()
    want = set(sorted(x["k"] for x in keys)[:50])
    for lang in {x["lang"] for x in keys}:
        want |= set(sorted(x["k"] for x in keys if x["lang"] == lang)[:3])
    assert got == want


def test_a_fifth_held_back_is_never_a_whole_language():
    texts = [prose(i, 12) for i in range(200)] + ["zzzz zyzy yzzy yyzz " * 5]
    labels = ["en"] * 200 + ["zz"]
    for seed in range(8):
        model = language_id.fit(texts, labels, language_id.LanguageParams(seed=seed))
        best, _ = model.predict(pa.array(["zyzy yyzz zzzz"], pa.large_string()))
        assert model.languages[best[0]] == "zz"


def test_each_text_of_a_repeated_id_is_compared(spark, make_docs):
    a, b = prose(1, 120), prose(2, 120)
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " tail"), (4, prose(3, 120))]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the texts of an id meet in one task
    try:
        for order in (rows, rows[::-1]):
            docs = make_docs([(i, t, "en") for i, t in order])
            pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "a long, b long")
            texts = docs.select(F.col("doc_id").alias("id"), "text")
            assert {tuple(x) for x in near_dedup.confirm(pairs, texts, near_dedup.NearParams()).collect()} == {(2, 1), (3, 1)}
            got = {tuple(x) for x in near_dedup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()}
            assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_one_row_of_each_group_of_near_duplicates_stays(spark, make_docs, no_docs):
    import corpus_pipeline

    a, b, c, d = (prose(k, 120) for k in (21, 22, 23, 24))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, c), (3, c + " tail"), (None, d), (None, d), (None, d + " tail"), (None, c),
            (4, "two words"), (4, "two words"), (5, None), (5, None), (None, ""), (None, ""), (6, " ")]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.drop_near_duplicates(spark, make_docs([(i, t, "en") for i, t in order]), "")
        assert got.columns == make_docs([]).columns
        got = [(r["doc_id"], r["text"]) for r in got.collect()]
        unique = [x for x in got if x[1] and x[1].strip()]
        assert sorted(x for x in unique if x[0] is not None and x[0] != 3) == [(1, a), (2, b), (4, "two words")]
        assert [x[1] in (c, c + " tail") for x in unique if x[0] == 3] == [True]
        assert [x[1] in (d, d + " tail") for x in unique if x[0] is None] == [True]
        assert len(got) - len(unique) == 5
    hot = make_docs([(i % 3, a, "en") for i in range(600)] + [(None, a, "en")] * 50)
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, hot, "").collect()] == [0]
    assert corpus_pipeline.drop_near_duplicates(spark, no_docs, "").collect() == []


def test_texts_with_runs_of_white_space_are_counted_by_pre_tokens(monkeypatch):
    counter = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
    encode, asked = counter.encode_counts, []
    monkeypatch.setattr(counter, "encode_counts", lambda texts: asked.extend(texts) or encode(texts))
    r = random.Random(4)
    bits = ["def", "x", "1", "'s", " ", " ", "    ", "\n\n", "\n        ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "é", "日本", "<|", "<|endoftext|>", "\u3000"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 15))) for _ in range(2000)]
    code = "def f(a):\n    if a:\n\n\n        return a\n    return None  "
    texts += [code, code, code + "<|endoftext|>   " + code]
    want = encode(texts)
    assert counter.texts(pa.array(texts, pa.large_string())).tolist() == want
    assert len(asked) == len(set(asked))  # each pre-token once
    asked.clear()
    counter.known = {}
    counter.texts(pa.array([code, code], pa.large_string()))
    assert len(asked) == len(set(asked)) and max(len(x.split()) for x in asked) <= 1


def test_copies_are_searched_once_and_all_answered(spark, make_docs):
    """A third of the rows are copies of one leaking text; items are repeated too."""
    items = [(k, prose(300 + k, 20)) for k in range(12)] + [(20, prose(300, 20))]
    rows = [(k, f"{prose(500 + k, 30)} {t} {items[(k + 5) % 12][1]}", "en") for k, t in items[:12]]
    docs = make_docs(rows * 2 + [(100 + n, rows[0][1], "en") for n in range(40)] + [(200 + n, prose(800 + n, 50), "en") for n in range(60)] + [(None, None, "en")])
    found = decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in found.collect()]
    first = {k: sorted({k, (k + 5) % 12} | ({20} if 0 in (k, (k + 5) % 12) else set())) for k in range(12)}
    want = [(k, first[k]) for k in range(12)] * 2 + [(100 + n, first[0]) for n in range(40)] + [(200 + n, []) for n in range(60)] + [(None, [])]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_toxicity_is_calibrated_on_whole_texts(spark, make_docs):
    r = random.Random(9)
    rows = []
    for i in range(150):
        words = prose(700 + i, 200).split()
        if i % 3 == 0:
            words.insert(r.randrange(200), "vilelu " * 3)
        rows.append((i, " ".join(words), "en"))
    docs, params = make_docs(rows + rows[:5]), toxicity.ToxicParams(epochs=2, word_buckets=1 << 10, gram_buckets=1 << 12)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    net = toxicity.learned(docs, labels, F.lit(True), params)
    sample, prior = toxicity.training_sample(docs, labels, F.lit(True), params)
    y = np.array([x["y"] for x in sample])
    held = np.random.default_rng(params.seed + 1).random(len(y)) < 0.2
    assert all(len(x["text"].split()) >= 200 for x in sample)  # whole, not pieces
    whole = {x["k"]: x["text"] for x in docs.select(F.xxhash64("text", "doc_id").alias("k"), "text").collect()}
    p = replace(net, scale=1.0, shift=0.0).score(pa.array([whole[x["_k"]] for x, h in zip(sample, held, strict=True) if h], pa.large_string()))
    weight = np.where(y[held] == 1, 1.0, (1 - prior) / prior * y.mean() / (1 - y.mean()))
    scale, shift = toxicity._platt(np.log(p) - np.log1p(-p), y[held].astype(np.float64), weight)
    assert abs(net.scale - scale) < 1e-3 and abs(net.shift - shift) < 1e-3


def test_slices_give_the_results_of_whole_batches():
    """Every slice of a batch, of either string type, has the words and hashes of its own texts."""
    import pyarrow as pa

    from dinerank.llm import common, shingles

    texts = [prose(900 + k, 30).upper() for k in range(50)]
    want = [s.tolist() for s in shingles.shingle_sets(pa.array(texts, pa.large_string()))]
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind), pa.array(["skipped", *texts], kind).slice(1)):
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            parts = list(common.slices([batch], size_of=700))
            assert len(parts) > 5
            got = [s.tolist() for part in parts for s in shingles.shingle_sets(common.strings(part.column("text")))]
            assert got == want


def test_near_duplicates_over_several_slices(spark):
    """sf0.01 in one partition, so that a task meets many slices: sets and links as by brute force."""
    from test_text_ops import check_near

    from dinerank.llm import near_dedup

    check_near(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1), near_dedup.NearParams())


def test_leaks_over_several_slices(spark):
    """Every item planted in a document of its own is found in every slice."""
    from dinerank.llm import decontamination

    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows = [(i, prose(i, 2000) + " " + text + " " + prose(i + 1, 2000)) for i, (_, text) in enumerate(items)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontamination.leaks(docs, bench).collect()}
    assert all(item in found[i] for i, (item, _) in enumerate(items))


def test_stages_keep_columns_named_like_their_own(spark):
    """Columns that clash with a stage's internal names come back as they were."""
    import corpus_pipeline

    names = ["_score", "_toxic", "_h", "_listed", "_r", "_leaks", "leaks", "score", "c0", "id"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == []
