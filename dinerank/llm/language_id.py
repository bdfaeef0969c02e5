"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent in numpy.

Every word gives its byte n-grams and itself as hashed features; a text is the
average of their embeddings, and a linear layer with softmax gives language
probabilities. A temperature fitted on held-back training texts calibrates
them; a text whose calibrated best probability stays below ``reject_below`` is
answered ``und``. The layer is linear, so a text's scores are the sum of
its words' scores: a task scores each distinct word of a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinerank.llm.common import map_arrow, scratch, segment_sums, slices, strings
from dinerank.llm.subwords import ngrams_of, word_blocks, words_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    sample_texts: int = 1500  # training texts drawn over all languages together, each read as a whole
    least_texts: int = 100  # and at least so many of every language, or all it has
    sizes: tuple[int, ...] = (2, 3, 4, 5)
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 3
    batch: int = 16
    rate: float = 0.5
    embedding_rate: float = 8.0  # of an embedding row, relative to rate: a row sees a fraction of the examples
    snippet_words: int = 25
    least_snippets: int = 400  # of a language in an epoch: fewer are repeated
    seed: int = 7


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # bucket x language: embedding times softmax layer
    bias: np.ndarray
    temperature: float
    params: LanguageParams

    def logits(self, column: pa.Array) -> np.ndarray:
        offsets, codes, words = words_of(column)
        word, count = np.zeros((len(words), len(self.languages))), np.zeros(len(words))
        for lo, block in word_blocks(words):
            grams, at = ngrams_of(block, self.params.sizes, self.params.buckets)
            word[lo:lo + len(block)] = np.add.reduceat(self.weights[grams], at[:-1], axis=0)
            count[lo:lo + len(block)] = np.diff(at)
        total = segment_sums(word[codes], offsets)
        n = segment_sums(count[codes], offsets)
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its calibrated probability)."""
        if not self.languages:
            return np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
        p = _softmax(self.logits(column) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Train on (text, language) pairs; a fifth of the texts sets the
    temperature, never all of a language. No pairs give a model without
    languages, which answers ``und``."""
    rng = np.random.default_rng(params.seed)
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((params.buckets, 0)), np.zeros(0), 1.0, params)
    held = rng.random(len(texts)) < 0.2 if len(texts) >= 20 else np.zeros(len(texts), dtype=bool)
    own_texts: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        own_texts.setdefault(label, []).append(i)
    for own in own_texts.values():
        if held[own].all():
            held[own[0]] = False
    grams_of, label_of = [], []
    for text, label, out in zip(texts, labels, held, strict=True):
        offsets, codes, words = words_of(pa.array([text], pa.large_string()))
        if out or not len(codes):
            continue
        grams, at = ngrams_of(words, params.sizes, params.buckets)
        for lo in range(0, len(codes), params.snippet_words):
            own = codes[lo:lo + params.snippet_words]
            grams_of.append(np.concatenate([grams[at[c]:at[c + 1]] for c in own]))
            label_of.append(languages.index(label))
    emb = rng.normal(0, 1 / params.dim, (params.buckets, params.dim)).astype(np.float32)
    out = np.zeros((params.dim, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    y = np.array(label_of, dtype=np.int64)
    # A language of few texts would hardly move the weights: its snippets come round more often.
    have = np.bincount(y, minlength=len(languages))
    again = [np.resize(np.flatnonzero(y == k), params.least_snippets - n) for k, n in enumerate(have) if 0 < n < params.least_snippets]
    examples = np.concatenate([np.arange(len(y)), *again])
    steps = params.epochs * max(1, -(-len(examples) // params.batch))
    done = 0
    for _ in range(params.epochs):
        order = rng.permutation(examples)
        for lo in range(0, len(order), params.batch):
            rate = params.rate * (1 - done / steps)
            done += 1
            rows = order[lo:lo + params.batch]
            idx = np.concatenate([grams_of[r] for r in rows])
            size = np.array([len(grams_of[r]) for r in rows])
            at = np.concatenate([[0], np.cumsum(size)])
            mean = np.add.reduceat(emb[idx], at[:-1], axis=0) / size[:, None]
            d = _softmax(mean @ out + bias)
            d[np.arange(len(rows)), y[rows]] -= 1
            back = (d @ out.T) / size[:, None]
            out -= rate * mean.T @ d
            bias -= rate / len(languages) * d.mean(axis=0)
            np.add.at(emb, idx, (-rate * params.embedding_rate * np.repeat(back, size, axis=0)).astype(np.float32))
    model = LanguageModel(languages, (emb @ out).astype(np.float64), bias.astype(np.float64), 1.0, params)
    if held.any():
        z = model.logits(pa.array([t for t, h in zip(texts, held, strict=True) if h], pa.large_string()))
        want = np.array([languages.index(x) for x, h in zip(labels, held, strict=True) if h])
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(z)), want] + 1e-12).mean() for t in np.geomspace(0.2, 5, 40)}
        model.temperature = float(min(loss, key=loss.get))
    return model


def training_sample(docs: DataFrame, learn: Column, params: LanguageParams, text_col: str = "text", lang_col: str = "lang") -> list:
    """Whole labelled texts in hash order: the ``sample_texts`` of least hash over
    all languages, and of every language the ``least_texts`` of least hash (all
    of them where it has fewer). At most sample_texts + least_texts x languages."""
    text, lang = F.col(text_col), F.col(lang_col)
    key = F.xxhash64(text, lang)
    usable = docs.where(learn & lang.isNotNull() & text.rlike(r"\p{L}"))
    # The hashes are drawn first, so that only drawn rows bring their text along.
    keys = scratch(docs).cut(usable.select(lang.alias("_l"), key.alias("_k")).distinct())
    # Of a large language only the start of its hash order is ranked: a share of
    # the hash range that holds eight times the texts asked for on average.
    counts = scratch(docs).cut(keys.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    within = lambda share: F.col("_k") / 2.0**64 + 0.5 <= share
    share = F.least(F.lit(8.0 * params.least_texts) / F.col("_n"), F.lit(1.0))
    near = keys.join(F.broadcast(counts), "_l").where(within(share))
    rank = F.row_number().over(Window.partitionBy("_l").orderBy("_k"))
    each = near.withColumn("_r", rank).where(F.col("_r") <= params.least_texts).select("_k")
    start = keys.where(within(F.lit(min(1.0, 8.0 * params.sample_texts / max(1, total)))))
    drawn = start.select("_k").orderBy("_k").limit(params.sample_texts).unionByName(each).distinct()
    return (usable.join(F.broadcast(drawn), key == F.col("_k"))
            .select("_k", text.alias("text"), lang.alias("lang"))
            .dropDuplicates(["_k"]).orderBy("_k").collect())


def identify(docs: DataFrame, model: LanguageModel, reject_below: float = 0.5, id_col: str = "doc_id",
             text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``id_col, <keep>, lang_pred, score, rejected`` per row of ``docs``.

    ``keep`` adds columns computed from the row. A null text, or one without
    any letter, is ``und`` with score 0; a score below ``reject_below`` gives
    ``und`` with that score and ``rejected``. Whole texts are read. Repeated
    rows and null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers
    keep = keep or {}
    src = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"),
                      F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
                      *[c.alias(name) for name, c in keep.items()])
    others = [f for f in src.schema.fields if f.name not in ("_text",)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", lang_pred string, score double, rejected boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for part in slices(batches, "_text", 2 << 20):
            best, p = model.predict(strings(part.column("_text")))
            letters = part.column("_letters").to_numpy(zero_copy_only=False)
            p = np.where(letters, p, 0.0)
            low = letters & (p < reject_below)
            best = np.where(letters & ~low, best, len(model.languages))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(f.name) for f in others], pa.array(names[best], pa.string()), pa.array(p), pa.array(low)],
                names=[*[f.name for f in others], "lang_pred", "score", "rejected"])

    return map_arrow(src, score, ddl).withColumnRenamed("_id", id_col).drop("_letters")
