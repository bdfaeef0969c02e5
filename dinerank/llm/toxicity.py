"""Toxicity scores from a bidirectional gated recurrent network in numpy.

A word enters as its own hashed embedding beside the mean of the embeddings of
its hashed character n-grams. Two gated recurrent units read a window of words
forwards and backwards, attention pools their states, and a logistic layer
scores the window. A text is cut into overlapping windows that cover all of
it; its score is that of its worst window, calibrated on held-back texts.

Labels belong to texts, not windows, so training picks windows: first the one
with the word that most sets toxic texts apart (the likelihood ratios also
start one embedding dimension), then per text the window the network
finds worst, which in a clean text is the hardest negative. Input projections depend only on the word, so
a task computes them once per distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinerank.llm.common import give_back, map_arrow, slices, strings
from dinerank.llm.subwords import ngrams_of, word_blocks, words_of
from dinerank.session import Scratch


@dataclass(frozen=True)
class ToxicParams:
    sample_toxic: int = 1200  # labelled training texts of either kind, each read as a whole
    sample_clean: int = 2600
    window: int = 32  # words
    stride: int = 20
    word_buckets: int = 1 << 14
    gram_buckets: int = 1 << 15
    sizes: tuple[int, ...] = (4,)
    word_dim: int = 8
    gram_dim: int = 16
    hidden: int = 8
    epochs: int = 5
    least_steps: int = 200  # more epochs where the sample is so small that these are not reached
    blind_share: float = 0.25  # of the epochs that pick windows without asking the network
    rescore_steps: int = 40  # steps after which the worst windows are looked up again
    batch: int = 64
    rate: float = 0.01
    row_rate: float = 10.0
    seed: int = 5


#: Windows worked on at once (memory: times window x hidden), in training and when scoring.
WINDOWS, SCORED = 4096, 512
#: Bytes of text scored at once: a word takes some sixty bytes of arrays.
SLICE = 512 << 10


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``words_of`` with runs of one repeated word as a single word: a line of
    the same word over and over says no more than the word."""
    offsets, codes, words = words_of(column)
    new = np.diff(codes, prepend=-1) != 0
    starts = offsets[:-1][np.diff(offsets) > 0]
    new[starts] = True
    return np.concatenate([[0], np.cumsum(new)])[offsets], codes[new], words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name; ``w_*`` input, ``u_*`` recurrent, ``b_*`` bias of the
    forward (f) and backward (b) units: gates z, r and candidate side by side."""

    params: ToxicParams
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fresh(params: ToxicParams) -> Network:
        rng = np.random.default_rng(params.seed)
        h, d = params.hidden, params.word_dim + params.gram_dim
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        p = {"word": rng.normal(0, 0.02, (params.word_buckets, params.word_dim)).astype(np.float32),
             "gram": rng.normal(0, 0.05, (params.gram_buckets, params.gram_dim)).astype(np.float32)}
        for side in "fb":
            p |= {f"w_{side}": draw(d, 3 * h), f"u_{side}": draw(h, 3 * h), f"b_{side}": np.zeros(3 * h, np.float32)}
        p |= {"att": draw(2 * h, 2 * h), "att_v": draw(2 * h), "out": draw(2 * h), "out_b": np.full(1, -1.0, np.float32)}
        return Network(params, p)

    def inputs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word vectors, word bucket, n-gram buckets, their offsets) of distinct words."""
        parts = [ngrams_of(block, self.params.sizes, self.params.gram_buckets) for _, block in word_blocks(words)]
        grams = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))]) if parts else np.zeros(1, np.int64)
        whole = grams[at[1:] - 1] % self.params.word_buckets
        vectors = np.empty((len(words), self.params.word_dim + self.params.gram_dim), np.float32)
        self.refresh(vectors, np.arange(len(words)), (whole, grams, at))
        return vectors, whole, grams, at

    def refresh(self, vectors: np.ndarray, used: np.ndarray, made: tuple) -> None:
        """Set the rows ``used`` of the word vectors from the current embeddings."""
        whole, grams, at = made
        for lo in range(0, len(used), 1 << 16):
            rows = used[lo:lo + (1 << 16)]
            size = np.diff(at)[rows]
            ends = np.cumsum(size)
            idx = grams[np.repeat(at[rows] - (ends - size), size) + np.arange(ends[-1])]
            vectors[rows, :self.params.word_dim] = self.p["word"][whole[rows]]
            vectors[rows, self.params.word_dim:] = np.add.reduceat(self.p["gram"][idx], ends - size, axis=0) / size[:, None]

    # Arrays below are (time, feature, window): the long axis is last.

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """States of one unit over projected inputs ``x``; masked steps keep the state."""
        h, u = self.params.hidden, self.p[f"u_{side}"].T
        u_zr, u_c = np.ascontiguousarray(u[:2 * h]), np.ascontiguousarray(u[2 * h:])
        steps, n = mask.shape
        state = np.zeros((h, n), np.float32)
        out = np.empty((steps, h, n), np.float32)
        for t in (range(steps) if side == "f" else range(steps - 1, -1, -1)):
            zr = u_zr @ state
            zr += x[t, :2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:h], zr[h:]
            c = u_c @ (r * state)
            c += x[t, 2 * h:]
            np.tanh(c, out=c)
            keep = z * mask[t]  # z: how much of the candidate enters
            if trace is not None:
                trace.append((t, state, z, r, c, keep))
            state = state + keep * (c - state)
            out[t] = state
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Attention over time, then the logit of each window."""
        g = np.tanh(np.matmul(self.p["att"].T, states))
        e = np.matmul(self.p["att_v"], g) - (1 - mask) * 1e4
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tfn->fn", a, states)
        return self.p["out"] @ pooled + self.p["out_b"][0], (g, a, pooled)

    def logits(self, codes: np.ndarray, table: dict[str, np.ndarray], most: int = WINDOWS) -> np.ndarray:
        """Logit of each window; ``codes`` (window, time) index the projected
        words of ``table``, -1 is padding."""
        out = np.empty(len(codes), np.float32)
        for lo in range(0, len(codes), most):
            c = np.ascontiguousarray(codes[lo:lo + most].T)
            mask = (c >= 0).astype(np.float32)
            both = []
            for side in "fb":
                x = np.empty((len(c), table[side].shape[1], c.shape[1]), np.float32)
                for t in range(len(c)):
                    x[t] = table[side][c[t]].T
                both.append(self.run(x, mask, side))
            out[lo:lo + most] = self.pool(np.concatenate(both, axis=1), mask)[0]
        return out

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Input side of both units per word; the last row (index -1) is padding."""
        padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        return {s: padded @ self.p[f"w_{s}"] + self.p[f"b_{s}"] for s in "fb"}

    def windows(self, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of every window, text of every window): starts 0, stride, ...
        so that consecutive windows overlap and the last reaches the text's end."""
        w, s = self.params.window, self.params.stride
        length = np.diff(offsets)
        count = np.maximum(1, -(-(length - w) // s) + 1)
        text = np.repeat(np.arange(len(length)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        out = np.full((len(text), w), -1, np.int32)
        start, stop = offsets[:-1][text] + k * s, offsets[1:][text]
        for t in range(w if len(codes) else 0):
            inside = start + t < stop
            out[inside, t] = codes[start[inside] + t]
        return out, text

    def score(self, column: pa.Array) -> np.ndarray:
        """Calibrated score of each whole text; one without words gets the score of silence."""
        offsets, codes, words = _sequence(column)
        vectors = np.empty((len(words), self.params.word_dim + self.params.gram_dim), np.float32)
        for lo, block in word_blocks(words):
            vectors[lo:lo + len(block)] = self.inputs(block)[0]
        table = self.project(vectors)
        windows, text = self.windows(offsets, codes)
        worst = np.full(len(column), -np.inf)
        np.maximum.at(worst, text, self.logits(windows, table, SCORED).astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(self.scale * worst + self.shift, -60, 60)))

    # -------------------------------------------------------------- training

    def step(self, codes: np.ndarray, y: np.ndarray, vectors: np.ndarray, optimiser: Optimiser, made: tuple) -> None:
        """One step on windows ``codes`` (window, time) with labels ``y``."""
        p, h = self.p, self.params.hidden
        c = codes.T
        mask = (c >= 0).astype(np.float32)
        x = np.where(mask[:, None, :] > 0, vectors[c].transpose(0, 2, 1), np.float32(0))
        traces: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([
            self.run(np.matmul(p[f"w_{s}"].T, x) + p[f"b_{s}"][:, None], mask, s, traces[s]) for s in "fb"], axis=1)
        logit, (g, a, pooled) = self.pool(states, mask)
        n = len(y)
        d = ((_sigmoid(logit) - y) / n).astype(np.float32)
        grad = {"out": pooled @ d, "out_b": np.array([d.sum()], np.float32)}
        d_pooled = np.outer(p["out"], d)
        d_a = np.einsum("tfn,fn->tn", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        grad["att_v"] = np.einsum("tfn,tn->f", g, d_e)
        d_g = p["att_v"][:, None] * d_e[:, None, :] * (1 - g * g)
        grad["att"] = np.tensordot(states, d_g, axes=([0, 2], [0, 2]))
        d_states = a[:, None, :] * d_pooled + np.matmul(p["att"], d_g)
        d_x = np.zeros_like(x)
        for side, lo in (("f", 0), ("b", h)):
            u_zr, u_c = p[f"u_{side}"][:, :2 * h], p[f"u_{side}"][:, 2 * h:]
            pre = np.zeros((len(c), 3 * h, n), np.float32)
            g_u = np.zeros_like(p[f"u_{side}"])
            d_s = np.zeros((h, n), np.float32)
            for t, state, z, r, cand, keep in reversed(traces[side]):
                d_s = d_s + d_states[t, lo:lo + h]
                d_c = d_s * keep * (1 - cand * cand)
                d_rs = u_c @ d_c
                pre[t, :h] = d_s * (cand - state) * mask[t] * z * (1 - z)
                pre[t, h:2 * h] = d_rs * state * r * (1 - r)
                pre[t, 2 * h:] = d_c
                g_u[:, :2 * h] += state @ pre[t, :2 * h].T
                g_u[:, 2 * h:] += (r * state) @ d_c.T
                d_s = d_s * (1 - keep) + d_rs * r + u_zr @ pre[t, :2 * h]
            grad |= {f"w_{side}": np.tensordot(x, pre, axes=([0, 2], [0, 2])), f"u_{side}": g_u, f"b_{side}": pre.sum(axis=(0, 2))}
            d_x += np.matmul(p[f"w_{side}"], pre)
        for name, v in grad.items():
            optimiser.dense(p, name, v)
        # Embedding rows of the words in the windows.
        whole, grams, at = made
        used, back = np.unique(c[c >= 0], return_inverse=True)
        per_word = np.zeros((len(used), x.shape[1]), np.float32)
        np.add.at(per_word, back, d_x.transpose(0, 2, 1)[c >= 0])
        dim, size = self.params.word_dim, np.diff(at)[used]
        idx = np.concatenate([grams[at[w]:at[w + 1]] for w in used]) if len(used) else grams[:0]
        optimiser.rows(p, "word", whole[used], per_word[:, :dim])
        optimiser.rows(p, "gram", idx, np.repeat(per_word[:, dim:] / size[:, None], size, axis=0))


class Optimiser:
    """Adam for the small matrices; for embedding rows a step in proportion to
    the gradient, so that rows of many texts outgrow those of a single one."""

    def __init__(self, params: ToxicParams):
        self.rate, self.row_rate = params.rate, params.row_rate
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}
        self.steps: dict[str, int] = {}

    def dense(self, p: dict[str, np.ndarray], name: str, grad: np.ndarray) -> None:
        k = self.steps[name] = self.steps.get(name, 0) + 1
        m = self.first[name] = 0.9 * self.first.get(name, np.zeros_like(grad)) + 0.1 * grad
        v = self.second[name] = 0.999 * self.second.get(name, np.zeros_like(grad)) + 0.001 * grad * grad
        p[name] -= self.rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)

    def rows(self, p: dict[str, np.ndarray], name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        unique, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(unique), grad.shape[1]), np.float32)
        np.add.at(total, inverse, grad)
        p[name][unique] -= self.row_rate * total


def fit(texts: list[str] | pa.Array, labels: list[int], params: ToxicParams = ToxicParams(), prior: float | None = None) -> Network:
    """Train on whole texts with labels (0 or 1); a fifth of them calibrates.
    ``prior``: share of toxic texts where the network will be used (default:
    as in the sample). Labels of one kind, or none, give a network whose
    score is constant."""
    net = Network.fresh(params)
    if len(set(labels)) < 2:  # nothing to tell apart: one score for all texts
        net.scale, net.shift = 0.0, 3.0 if set(labels) == {1} else -3.0
        return net
    rng = np.random.default_rng(params.seed + 1)
    y = np.array(labels, dtype=np.float32)
    offsets, codes, words = _sequence(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    give_back()
    vectors, *made = net.inputs(words)
    windows, text = net.windows(offsets, codes)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    count = np.diff(np.append(first, len(text)))
    held = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), dtype=bool)
    optimiser = Optimiser(params)
    mine = np.flatnonzero(~held)
    vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    signal = _word_signal(net, codes, offsets, y, mine, made)
    net.refresh(vectors, np.arange(len(words)), made)
    epochs = max(params.epochs, -(-params.least_steps * params.batch // max(1, len(mine))))
    # Without the network: the window with the word of the strongest signal.
    padded = np.append(signal, -np.inf)
    strongest = np.full(len(windows), -np.inf)
    for t in range(windows.shape[1]):
        np.maximum(strongest, padded[windows[:, t]], out=strongest)
    worst = _worst(strongest + 1e-6 * rng.random(len(windows)), first, text)
    since = 0
    for epoch in range(epochs):
        if epoch >= params.blind_share * epochs and since >= params.rescore_steps:
            net.refresh(vectors, np.arange(len(words)), made)
            worst, since = _worst(net.logits(windows, net.project(vectors[:-1])), first, text), 0
        # The worst window of each text, and a random one of each clean text.
        clean = mine[y[mine] == 0]
        chosen = rng.permutation(np.concatenate([worst[mine], first[clean] + (rng.random(len(clean)) * count[clean]).astype(np.int64)]))
        for k, lo in enumerate(range(0, len(chosen), params.batch)):
            optimiser.rate = params.rate * (1 - 0.9 * (epoch + k * params.batch / len(chosen)) / epochs)
            own = windows[chosen[lo:lo + params.batch]]
            net.refresh(vectors, np.unique(own[own >= 0]), made)
            net.step(own, y[text[chosen[lo:lo + params.batch]]], vectors, optimiser, made)
            since += 1
    net.refresh(vectors, np.arange(len(words)), made)
    final = net.logits(windows, net.project(vectors[:-1]))
    best = np.maximum.reduceat(final, first)
    rows = held if held.any() and len(set(y[held])) == 2 else np.ones(len(y), dtype=bool)
    share = float(y.mean())
    weight = np.where(y[rows] == 1, 1.0, 1.0 if prior is None else (1 - prior) / prior * share / (1 - share))
    net.scale, net.shift = _platt(best[rows].astype(np.float64), y[rows].astype(np.float64), weight)
    return net


#: Root of twice the log-likelihood ratio below which a feature counts as chance.
CHANCE = 2.5


def _word_signal(net: Network, codes: np.ndarray, offsets: np.ndarray, y: np.ndarray, mine: np.ndarray, made: tuple) -> np.ndarray:
    """Start the first dimension of both embeddings from the signed likelihood
    ratio between texts with and without the feature in toxic and clean texts
    (training texts only); returns the sum of both parts per distinct word."""
    whole, grams, at = made
    toxic, total = y[mine].sum(), len(mine)

    def ratio(feature_of_word: np.ndarray, word_of_entry: np.ndarray, buckets: int) -> np.ndarray:
        seen = np.zeros((2, buckets))
        entries_at = np.concatenate([[0], np.cumsum(np.bincount(word_of_entry, minlength=len(at) - 1))])
        for t in mine:
            own = np.unique(codes[offsets[t]:offsets[t + 1]])
            if len(own):
                features = np.unique(np.concatenate([feature_of_word[entries_at[w]:entries_at[w + 1]] for w in own]))
                seen[int(y[t]), features] += 1
        n1, n0, t1, t0 = seen[1], seen[0], max(toxic, 1), max(total - toxic, 1)
        mean = (n1 + n0) / (t1 + t0)
        g = sum(k * np.log(np.maximum(k, 1e-9) / np.maximum(m, 1e-9)) for k, m in (
            (n1, t1 * mean), (n0, t0 * mean), (t1 - n1, t1 * (1 - mean)), (t0 - n0, t0 * (1 - mean))))
        root = np.sqrt(np.maximum(2 * g, 0)) - CHANCE
        return np.where((root > 0) & (n1 * t0 > n0 * t1), np.minimum(root, 8), 0).astype(np.float32)

    words = np.arange(len(at) - 1)
    by_word = ratio(whole, words, net.params.word_buckets)
    by_gram = ratio(grams, np.repeat(words, np.diff(at)), net.params.gram_buckets)
    net.p["word"][:, 0] += by_word / 4
    net.p["gram"][:, 0] += by_gram
    return by_word[whole] / 4 + np.add.reduceat(by_gram[grams], at[:-1]) / np.diff(at) if len(words) else np.zeros(0)


def _worst(logits: np.ndarray, first: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Index of each text's highest window."""
    order = np.lexsort((logits, text))
    return order[np.append(first[1:], len(text)) - 1]


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a weighted logistic calibration (Newton steps, mild prior)."""
    a, b = 1.0, 0.0
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        grad = x.T @ (weight * (q - target)) + np.array([1e-2 * (a - 1), 0])
        hess = (x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _usable(docs: DataFrame, learn: Column, text_col: str, id_col: str) -> tuple[DataFrame, Column]:
    """``_d, _t`` of the rows to learn from that have a text, and their key."""
    own = docs.where(learn).select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_t")).where("length(_t) > 0")
    return own, F.xxhash64("_t", "_d")


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, params: ToxicParams, text_col: str = "text",
                    id_col: str = "doc_id", label_col: str = "toxic") -> tuple[list, float | None]:
    """(rows ``text, y``, share of toxic rows among all labelled ones): at most
    ``sample_toxic`` and ``sample_clean`` labelled texts in hash order, whole. A
    share of the hash range that holds eight times as many on average is
    ranked, so no task hands on more than it."""
    marked = labels.select(F.col(id_col).alias("_l"), F.col(label_col).alias("_y")).where("_y in (0, 1)").groupBy("_l").agg(
        F.max("_y").cast("int").alias("y"))
    own, key = _usable(docs, learn, text_col, id_col)
    hashed = own.select("_d", key.alias("k"))  # before the join, so that no text is shuffled
    job = Scratch(docs.sparkSession)
    # The labelled ids meet the texts' hashes first; only drawn rows carry text.
    drawn = job.cut(hashed.join(marked, F.col("_d") == F.col("_l")).select("k", "_d", "y"))
    n = {r["y"]: r["n"] for r in drawn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for y, most in ((1, params.sample_toxic), (0, params.sample_clean)):
        share = min(1.0, 8.0 * most / max(1, n.get(y, 0)))
        near = drawn.where((F.col("y") == y) & (F.col("k") / 2.0**64 + 0.5 <= share))
        ids = near.orderBy("k", "_d").limit(most).select(F.col("k").alias("_k"), "y")
        rows += own.join(F.broadcast(ids), key == F.col("_k")).select(F.col("_t").alias("text"), "y", "_k").orderBy("_k").limit(most).collect()
    toxic, clean = n.get(1, 0), n.get(0, 0)
    return rows, toxic / (toxic + clean) if toxic and clean else None


def learned(docs: DataFrame, labels: DataFrame, learn: Column, params: ToxicParams = ToxicParams(), text_col: str = "text",
            id_col: str = "doc_id") -> Network:
    """A network fitted to the labelled rows of ``docs`` for which ``learn`` holds.
    A null or empty text is not learned from; without labels of both kinds
    the score is constant."""
    rows, prior = training_sample(docs, labels, learn, params, text_col, id_col)
    texts, marks = pa.array([r["text"] for r in rows], pa.large_string()), [r["y"] for r in rows]
    del rows  # the texts are held once while the network is fitted
    give_back()
    net = fit(texts, marks, params, prior)
    give_back()
    return net


def score_texts(docs: DataFrame, net: Network, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None,
                extra: dict[str, Column] | None = None, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``<keep>, <extra>, score, predicted`` per row of ``docs``.

    Every overlapping window of the whole text is scored. A null or empty
    text has no words and gets the network's score of an empty window.
    Repeated rows and null ids stay; columns not in ``keep`` are ignored, kept
    ones named like a new column give way to it; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters
    extra = extra or {}
    names = [c for c in keep or [] if c not in {score, predicted, *extra}]
    src = docs.select(*[docs[c] for c in names], *[c.alias(k) for k, c in extra.items()], docs[text_col].cast("string").alias("_text_"))
    fields = src.schema.fields[:-1]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{score}` double", f"`{predicted}` int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part in slices(batches, "_text_", SLICE):
            s = net.score(strings(part.column("_text_")))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[*[f.name for f in fields], score, predicted])

    return map_arrow(src, run, ddl)
