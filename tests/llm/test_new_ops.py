"""Embedding near-dedup, filter audit and manifest against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from llm_helpers import SF, make_docs, no_docs, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F

from dinerank.llm import filter_audit, manifest, vector_dedup
from dinerank.llm.queries import oracle_sql, op11_embedding_dedup, op12_filter_audit, op13_manifest

VECTORS = "vec_id long, embedding array<float>, label int, id long, w long, v string, h1 string, component string"


# ------------------------------------------------------- embedding near-dedup

def brute_links(rows, least=0.95):
    """(vec_id, n_links, component) per row; rows of one id are one node."""
    good = [i for i, (k, e) in enumerate(rows) if k is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, parent = Counter(), {rows[i][0]: rows[i][0] for i in good}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by = defaultdict(list)
    for i in good:
        by[len(rows[i][1])].append(i)
    for own in by.values():
        x = np.array([rows[i][1] for i in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        for a, b in zip(*np.nonzero(s >= least)):
            if a != b:
                links[own[a]] += 1
                p, q = sorted((root(rows[own[a]][0]), root(rows[own[b]][0])))
                parent[q] = p
    return [(k, links[i], root(k) if i in parent_ids(good) else k) for i, (k, _) in enumerate(rows)]


def parent_ids(good):
    return set(good)


def near_rows(seed=0, singles=600, groups=40, dim=24):
    r = np.random.default_rng(seed)
    base = r.normal(size=(singles, dim))
    rows = [x for x in base]
    for g in range(groups):
        c = r.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(int(r.integers(2, 9)) if g else 150):
            n = r.normal(size=dim)
            rows.append(3 * (c + r.uniform(0.02, 0.16) * n / np.linalg.norm(n)))
    order = r.permutation(len(rows))
    return [(int(i) * 3, [float(np.float32(v)) for v in rows[j]]) for i, j in enumerate(order)]


def frame(spark, rows):
    return spark.createDataFrame([(k, e, 1, 5, 6, "x", "y", "z") for k, e in rows], VECTORS)


def tuples(df):
    return Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 32])
def test_links_match_brute_force(spark, block):
    rows = near_rows()
    params = vector_dedup.GridParams(cell_rows=40, block=block, recall=1.0)
    got = tuples(vector_dedup.link_vectors(frame(spark, rows), params))
    assert got == Counter((k, n, c, k == c) for k, n, c in brute_links(rows))


def test_odd_vectors(spark):
    e = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, e), (2, e), (2, e), (3, [2.0, 4.0, 6.0, 8.0]), (4, None), (5, [0.0] * 4), (6, [1.0, None, 2.0, 3.0]), (7, [float("nan")] * 4),
            (8, [float("inf"), 1.0, 1.0, 1.0]), (9, []), (None, e), (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [-1.0, -2.0, -3.0, -4.0]),
            (20, [4.0, -3.0, 2.0, 0.0]), (21, [4.0, -3.0, 2.0, 0.1]), (21, [0.0, 0.0, 0.0, 1.0]), (22, [0.0, 0.0, 0.1, 1.0]), (23, [1e-30, 0.0, 0.0, 0.0])]
    got = tuples(vector_dedup.link_vectors(frame(spark, rows), vector_dedup.GridParams(recall=1.0)))
    want = Counter((k, n, c, k == c if k is not None else True) for k, n, c in brute_links(rows))
    assert got == want
    assert got[(1, 3, 1, True)] == 1 and got[(22, 1, 20, False)] == 1


def test_no_vectors(spark):
    assert vector_dedup.link_vectors(frame(spark, []).limit(0)).collect() == []
    only = vector_dedup.link_vectors(frame(spark, [(4, None), (5, [0.0])]))
    assert tuples(only) == Counter([(4, 0, 4, True), (5, 0, 5, True)])


def test_traversal_is_in_order_of_summed_distances():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = vector_dedup.fit_grid(x, 500, vector_dedup.GridParams(cell_rows=10))
    k = len(grid.books[0])
    d1, d2 = grid.distances(x)
    total = (d1[:, :, None] + d2[:, None, :]).reshape(len(x), k * k)
    for row, cells in zip(total, grid.visits(x), strict=True):
        want = np.flatnonzero(row <= row.min() + grid.slack)
        assert cells[0] == row.argmin() and set(cells) == set(want)
        assert (np.diff(row[cells]) >= 0).all()


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs at a cosine just above the threshold, the hardest to meet, on many cells."""
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = r.normal(size=x.shape)
    n -= (n * x).sum(1, keepdims=True) * x
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    y = 0.9505 * x + np.sqrt(1 - 0.9505 ** 2) * n
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(np.concatenate([x, y]))]
    got = vector_dedup.link_vectors(frame(spark, rows), vector_dedup.GridParams(cell_rows=20)).collect()
    unit = np.array([e for _, e in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = int((unit @ unit.T >= 0.95).sum() - len(rows))
    found = sum(g["n_links"] for g in got)
    assert 0.98 * true <= found <= true


def test_op11_matches_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in op11_embedding_dedup(spark, SF).collect())
    assert got == Counter((k, n, c, k == c) for k, n, c in brute_links(rows))


# ---------------------------------------------------------------- filter audit

def brute_audit(docs, labels):
    """docs (id, source, text); labels (id, quality, toxic)."""
    import re

    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, s, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((s or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        rows = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = rows
            for step, name in enumerate(order, 1):
                gone = [f for f in alive if name in f[1]]
                alive = [f for f in alive if name not in f[1]]
                shapley[part, name] += len(gone)
                out[part, order, step] = [len(alive), len(gone), sum(name in f[1] for f in rows) - len(gone),
                                          sum(f[1] == {name} for f in rows), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


AUDIT_DOCS = "doc_id long, text string, source string, t string, part string, bits int, h string, n long, id long"


def audit_docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "q", "q", 1, "q", 2, 3) for i, s, t in rows], AUDIT_DOCS)


def test_audit_matches_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    docs = [(1, "web", prose(1, 80)), (2, "web", prose(1, 80)), (2, "web", prose(1, 80)), (3, "book", prose(1, 80)), (4, "web", None), (5, None, ""),
            (None, "web", prose(1, 80)), (None, "web", None), (6, "book", "A B # C"), (7, "", "x " * 200), (8, "book", long), (9, "book", long + " $"),
            (10, "web", prose(5, 60).upper()), (10, "web", prose(6, 60)), (11, "web", "Zoë 日本 " * 30), (0, "new", prose(9, 70))]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (4, None, 1), (None, 1, 1), (6, 1, None), (10, 1, 1), (99, 1, 1)]
    got = filter_audit.audit(audit_docs(spark, docs), spark.createDataFrame([(*r, "q") for r in labels], "doc_id long, quality int, toxic int, part string"))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}
    assert found == brute_audit(docs, labels)


def test_audit_of_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(audit_docs(spark, []), labels).collect() == []
    one = filter_audit.audit(audit_docs(spark, [(1, "s", "a")]), labels)
    assert one.count() == 600


def same_as_sql(spark, name, query):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = query(spark, SF).toPandas(), con.sql(oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    flat = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert flat(got).equals(flat(want))


def test_op12_matches_sql(spark):
    same_as_sql(spark, "op12_filter_audit", op12_filter_audit)


# -------------------------------------------------------------------- manifest

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_tree(leaves):
    """(root, proof of each leaf as a list of (before, after))."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for n, p in enumerate(at):
            lo = p - p % 8
            proofs[n].append(("".join(level[lo:p]), "".join(level[p + 1:lo + 8])))
        at = [p // 8 for p in at]
        level = [sha("".join(level[k:k + 8])) for k in range(0, len(level), 8)]
    return level[0], proofs


def brute_manifest(docs):
    """docs (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: sha("".join(map(field, d)))
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[g] = brute_tree([leaf(d) for d in groups[g]])
    root, tops = brute_tree([trees[g][0] for g in names])
    out = Counter()
    for g, top in zip(names, tops):
        for d, own in zip(groups[g], trees[g][1]):
            path = own + top
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            node = leaf((*d[:4], low(d[4])) if changed else d)
            for before, after in path:
                node = sha(before + node + after)
            out[d[0], leaf(d), trees[g][0], root, sha("".join(a + b for a, b in path)), node, node == root] += 1
    return out


def manifest_of(df, height):
    tampered = F.crc32(df["doc_id"].cast("string").cast("binary")) % 3 == 0
    got = manifest.manifest(df, tampered, {"text": manifest.lower_ascii(df["text"])}, height=height)
    return Counter(tuple(r)[:7] for r in got.drop("path").collect())


MANIFEST_DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string, other string, id long, start long"


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_matches_brute_force(spark, height):
    docs = [(i, "s", "en", i, f"Text {i}") for i in range(150)] + [(i, None, "de", None, None) for i in range(9)]
    docs += [(7, "s", None, 1, "lone")] + [(None, "s", "fr", 2, "Ab"), (None, "s", "fr", 2, "Ac"), (3, "s", "fr", 2, "")]
    docs += [(5, "é日", "zh", 3, "B" * 30_000)] * 20 + [(4, "s", "", 1, "empty name"), (5, "s", "Zz", 1, "x"), (6, "s", "é", 1, "y")]
    docs += [(i, "s", f"l{i}", 1, "T") for i in range(70)]
    df = spark.createDataFrame([(*d, "x", "y", "z", 1, 2) for d in docs], MANIFEST_DOCS)
    assert manifest_of(df, height) == brute_manifest(docs)


def test_manifest_of_little(spark):
    assert manifest_of(spark.createDataFrame([], MANIFEST_DOCS), 4) == Counter()
    one = [(1, "s", "en", 4, "Text")]
    assert manifest_of(spark.createDataFrame([(*one[0], "x", "y", "z", 1, 2)], MANIFEST_DOCS), 4) == brute_manifest(one)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_fill_the_tree_top_first(levels):
    every = np.concatenate([manifest.address(levels, d, np.arange(8 ** d)) for d in range(levels)])
    assert sorted(every) == list(range(manifest.nodes_in(levels)))
    top = levels // 2
    if top:
        assert max(manifest.address(levels, top - 1, np.arange(8 ** (top - 1)))) < manifest.nodes_in(top)
        # A bottom tree lies in one piece.
        under = np.concatenate([manifest.address(levels, d, np.arange(8 ** (d - top))) for d in range(top, levels)])
        assert sorted(under) == list(range(manifest.nodes_in(top), manifest.nodes_in(top) + manifest.nodes_in(levels - top)))


def test_op13_matches_sql(spark):
    same_as_sql(spark, "op13_manifest", op13_manifest)


def test_op2_matches_sql(spark):
    from dinerank.llm.queries import op2_topk_search

    same_as_sql(spark, "op2_topk_search", op2_topk_search)
