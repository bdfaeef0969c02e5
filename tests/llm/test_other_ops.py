"""Search, classifiers, packing, token counts, sharding and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_helpers import SF, make_docs, no_docs, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dinerank.llm import language_id, packing, sharding, token_counts, topk_search, toxicity
from dinerank.llm import queries as llm_queries

# ------------------------------------------------------------------- search


def brute_top(rows, k, is_query):
    """rows of (id, integer vector or None)."""
    valid = [(i, v) for i, v in rows if i is not None and v is not None]
    out = set()
    for q, v in {i: min(x for j, x in valid if j == i) for i, _ in valid if is_query(i)}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in valid if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_search_matches_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.randint(-3, 3) / 64 for _ in range(3)]) for i in range(400)]  # many ties
    table = [(i, v, 1) for i, v in rows] + [(None, [0.0] * 3, 1), (1000, None, 1), (1001, [float("nan")] * 3, 1),
                                            (1002, [float("inf"), 0.0, 0.0], 1), (1003, [1.0, None, 2.0], 1), (1004, [], 1), (1005, [0.5, 0.5], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, id int")
    for params in (topk_search.SearchParams(), topk_search.SearchParams(k=7, shard_rows=60, block_rows=9, leaf=4)):
        got = {tuple(x) for x in topk_search.top_k(df, df["vec_id"] % 20 == 0, 64.0, params).select(
            "query_id", "rank", "vec_id", "score").collect()}
        own = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows] + [(1005, [32, 32])]
        assert got == brute_top(own, params.k, lambda i: i % 20 == 0)
    few = df.where("vec_id < 5")
    assert topk_search.top_k(few, F.col("vec_id") == 0).count() == 4
    assert topk_search.top_k(df.limit(0), F.lit(True)).collect() == []


def test_search_query(spark):
    got = {tuple(r) for r in llm_queries.op2_topk_search(spark, SF).select("query_id", "rank", "vec_id", "score").collect()}
    rows = [(r["vec_id"], [int(np.floor(64 * float(x))) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == brute_top(rows, 20, lambda i: i % 20 == 0)


# -------------------------------------------------------------- classifiers

def toxic_texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(seed * 1000 + i, r.randint(20, 120)).split()
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), "vilelu" + r.choice(["", "s", "ing", "er", "xyz"]))
        out.append((" ".join(words), int(toxic)))
    return out


def test_network_learns_and_gradients_are_right():
    params = toxicity.ToxicParams(epochs=6, word_buckets=1 << 10, gram_buckets=1 << 12)
    train, test = toxic_texts(500, 1), toxic_texts(200, 2)
    net = toxicity.fit([t for t, _ in train], [y for _, y in train], params)
    s = net.score(pa.array([t for t, _ in test], pa.large_string()))
    y = np.array([y for _, y in test])
    assert ((s >= 0.3) == y).mean() > 0.95
    # one step of training changes a parameter along the numerical gradient
    small = toxicity.Network.fresh(toxicity.ToxicParams(word_buckets=64, gram_buckets=64, window=5, hidden=3))
    for k in small.p:
        small.p[k] = small.p[k].astype(np.float64)
    column = pa.array(["aa bb cc dd ee ff", "gg hh"], pa.large_string())
    offsets, codes, words = toxicity._sequence(column)
    vectors, *made = small.inputs(words)
    vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    windows, _ = small.windows(offsets, codes)
    labels = np.arange(len(windows)) % 2

    class Keep(toxicity.Optimiser):
        def __init__(self):
            self.seen = {}

        def dense(self, p, name, grad):
            self.seen[name] = grad.copy()

        def rows(self, p, name, rows, grad):
            pass

    keep = Keep()
    small.step(windows, labels, vectors, keep, made)

    def loss():
        z = small.logits(windows, small.project(vectors)).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, z, -z)))))

    for name in ("w_f", "u_f", "b_b", "u_b", "att", "att_v", "out", "out_b"):
        flat = small.p[name].reshape(-1)
        for at in (0, len(flat) // 2, len(flat) - 1):
            old = flat[at]
            flat[at] = old + 1e-3
            up = loss()
            flat[at] = old - 1e-3
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-3 - keep.seen[name].reshape(-1)[at]) < 2e-3


def test_windows_cover_whole_texts():
    net = toxicity.Network.fresh(toxicity.ToxicParams(window=8, stride=5, word_buckets=64, gram_buckets=64))
    offsets = np.array([0, 0, 3, 40, 48])
    windows, text = net.windows(offsets, np.arange(48))
    for t in range(4):
        own = windows[text == t]
        assert set(own[own >= 0].tolist()) == set(range(offsets[t], offsets[t + 1]))
        assert len(own) >= 1


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (8, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    net = toxicity.learned(odd_docs, labels, F.lit(True), toxicity.ToxicParams(epochs=1))
    out = toxicity.score_texts(odd_docs, net, keep=odd_docs.columns)
    assert set(out.columns) == set(odd_docs.columns) | {"predicted"}
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").split()}) == 1
    assert toxicity.score_texts(no_docs, net).collect() == []
    idle = toxicity.learned(odd_docs, labels.limit(0), F.lit(True))
    assert all(r["predicted"] == 0 for r in toxicity.score_texts(odd_docs, idle).collect())


def test_toxicity_query_holds_out_and_separates(spark):
    sf = SF.replace("0.001", "0.01")
    rows = llm_queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [(r["score"], r["toxic"]) for r in rows if r["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8


def test_languages(spark, odd_docs, no_docs):
    r = random.Random(3)

    def text(chars):
        return " ".join("".join(r.choice(chars) for _ in range(r.randint(2, 6))) for _ in range(30))

    kinds = {"xx": "abcdef", "yy": "ghijkl", "zz": "mnopqr"}
    data = [(text(c), k) for k, c in kinds.items() for _ in range(60)]
    model = language_id.fit([t for t, _ in data], [k for _, k in data])
    best, p = model.predict(pa.array([text(kinds["yy"]), text(kinds["zz"])], pa.large_string()))
    assert [model.languages[b] for b in best] == ["yy", "zz"] and (p > 0.8).all()
    mixed = " ".join(text(c) for c in kinds.values())
    assert model.predict(pa.array([mixed], pa.large_string()))[1][0] < p.min()
    rows = language_id.identify(odd_docs, model, reject_below=0.0).collect()
    assert len(rows) == odd_docs.count()
    for x in rows:
        assert (x["lang_pred"] == "und") == (x["doc_id"] in (4, 5, 6) or x["doc_id"] is None and x["score"] == 0)
    strict = language_id.identify(odd_docs, model, reject_below=1.01).collect()
    assert all(x["lang_pred"] == "und" for x in strict)
    assert language_id.identify(no_docs, model).collect() == []
    none = language_id.fit([], [])
    assert {x["lang_pred"] for x in language_id.identify(odd_docs, none).collect()} == {"und"}
    assert language_id.training_sample(no_docs, F.lit(True), language_id.LanguageParams()) == []


def test_language_query_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = llm_queries.op6_language_id(spark, SF.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


# ------------------------------------------------------ tokens and packing

ODD = ["", "a  b", "a   b", "x <|endoftext|> y", "don't  'S I'LL\t\tx  y", "Ａé́ İstanbul ΣΑΣ", "  lead", "trail  ", "\n\n \n a\n\n",
       "日本 語　x", "<|ENDOFTEXT|> <|startoftext|>a", "a\x1cb \x85 c\x0b\x0cd 12 3½ ² x\x85y x\xa0y", "a\n b \n", "word, word. (word)"]


def test_counts_equal_the_library(spark, odd_docs, no_docs, make_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, x, "en") for i, x in enumerate(ODD)] + [(100, prose(1, 700), "en")]
    for docs in (make_docs(rows), odd_docs):
        got = Counter(tuple(r) for r in token_counts.token_counts(docs, path).collect())
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
            want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 512)] += 1
        assert got == want
    assert token_counts.token_counts(no_docs, path).collect() == []


def test_token_query(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    src = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = llm_queries.op9_token_counts(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in src.items()}


def check_packing(rows, src, capacity, end_id=1):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in src:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        for k, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo:lo + capacity]
            want[(i, k, lo, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in rows)


def test_packing_of_odd_rows(spark, odd_docs, no_docs, make_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    for docs in (odd_docs, make_docs([(i, x, "en") for i, x in enumerate(ODD)])):
        src = [(r["doc_id"], r["text"]) for r in docs.collect()]
        check_packing(packing.pack(docs, path, 64).collect(), src, 64)
    assert packing.pack(no_docs, path).collect() == []


def test_packing_query(spark):
    src = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, total = check_packing(llm_queries.op4_packing(spark, SF).collect(), src, 4096)
    assert used <= -(-total // 4096) + 1


def test_solutions_place_every_piece():
    r = np.random.default_rng(5)
    for _ in range(200):
        capacity = 20
        counts = Counter(r.integers(1, capacity + 1, r.integers(0, 60)).tolist())
        placed = Counter()
        for layout, times in packing.solve(counts, capacity):
            assert times > 0 and sum(n * k for n, k in layout) <= capacity
            for n, k in layout:
                placed[n] += k * times
        assert placed == counts
    # exact complements leave nothing open: single, pair and triple
    for counts, best in (({12: 3, 8: 3}, 3), ({10: 2, 6: 2, 4: 2}, 2), ({9: 2, 5: 2, 4: 2, 2: 2}, 2)):
        assert sum(t for _, t in packing.solve(counts, 20)) == best


# ----------------------------------------------------------------- sharding

def check_shards(rows, docs, shards):
    src = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in src)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    groups = defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[(r["size"], r["text_crc32"])].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())


def test_shards(spark, odd_docs, no_docs, make_docs):
    check_shards(sharding.shard(odd_docs).collect(), odd_docs, 8)
    assert sharding.shard(no_docs).collect() == []
    r = random.Random(2)
    docs = make_docs([(i, prose(i % 150, r.randint(1, 1)) + "x" * (i % 150), "en") for i in range(600)])
    rows = sharding.shard(docs).collect()
    check_shards(rows, docs, 8)
    total = Counter()
    for x in rows:
        total[x["shard"]] += x["size"]
    assert len(total) == 8 and max(total.values()) <= 1.1 * min(total.values())


def test_shard_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_shards(llm_queries.op10_sharding(spark, SF).collect(), docs, 8)


def test_best_fit_decreasing_by_tree_equals_a_plain_search():
    r = random.Random(9)
    for _ in range(60):
        capacity = 50
        sizes = [r.randint(1, 50) for _ in range(r.randint(0, 80))]
        bins, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(rest, b) for b, rest in enumerate(bins) if rest >= sizes[i]]
            if fits:
                want[i] = min(fits)[1]
            else:
                bins.append(capacity)
                want[i] = len(bins) - 1
            bins[want[i]] -= sizes[i]
        assert sharding.best_fit_decreasing(sizes, capacity) == want


# ----------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, make_docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(set(texts)) == len(texts) and len(texts) < docs.count()
    clean = stages["decontamination"](spark, docs, SF)
    leaked = {r["doc_id"] for r in llm_queries.op7_decontamination(spark, SF).collect()}
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()} == leaked
    redacted = {r["doc_id"]: r for r in stages["secrets"](spark, docs, SF).collect()}
    assert len(redacted) == docs.count()
    for r in docs.collect():
        x = redacted[r["doc_id"]]
        assert x["n_chars"] == len(x["text"]) and (x["text"] == r["text"] or "[SECRET]" in x["text"])
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and max(r["offset"] + r["length"] for r in out) <= 4096


def test_pipeline_of_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "", 0)], "item_id long, text string, x int").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()
