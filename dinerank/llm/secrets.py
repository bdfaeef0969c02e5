"""Secret scanning: fixed patterns plus a battery of randomness tests.

The patterns find assignments to secret-like names, access keys and long
hexadecimal runs. The battery looks at every other token that could be a key:
20 or more characters of an inferred encoding (hex, base32, base64,
base64url) that mixes letters and digits. Per token three statistics are
computed: chi-squared uniformity over the alphabet, the runs of
alphabet halves, and the serial correlation of neighbouring characters.
Natural text (words, paths, identifiers) has far from uniform characters; the
null hypothesis of a token is that its characters come from the text's own
character frequencies, which are counted over all documents in runs too short to
be keys, so that keys are no part of it; an alphabet of one case takes the letters
of both. The three scores depend on each other: their weighted sum is measured
against that of tokens drawn from the null, which gives one p-value, and
Benjamini-Hochberg is applied over all tokens of all documents, separately per
length class, so that the many short tokens do not pay for, or hide behind, the
long ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinerank.llm.common import map_arrow, slices

#: The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the same as runs of one or more, short ones dropped
KINDS = ("assign", "access", "hex", "random")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LONG = re.compile(TOKEN.pattern.encode())
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Alphabets from the smallest to the largest; a token has the first that holds all its characters.
ENCODINGS = {
    "hex_lower": "0123456789abcdef", "hex_upper": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36_lower": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": LETTERS[:62] + "+/", "base64url": LETTERS[:62] + "-_",
}
_CODE = np.full(128, -1, dtype=np.int64)
_CODE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
#: Steps per unit of -log10 p at which p-values are counted (rounded towards 1).
BINS = 50


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token; tokens without both a
    letter and a digit, or of mixed alphabets, have none."""
    chars = set(token)
    if not any(c.isdigit() for c in chars) or not any(c.isalpha() for c in chars):
        return None
    return next((name for name, alphabet in ENCODINGS.items() if chars <= set(alphabet)), None)


def statistics(at: np.ndarray, digit: np.ndarray, freq: np.ndarray) -> float:
    """Weighted sum of the three scores of a token with characters ``at`` (places in
    the alphabet), against the null frequencies ``freq`` of the alphabet; ``digit``
    marks the alphabet's digits. High for tokens far more uniform than the text."""
    k, n = len(freq), len(at)
    counts = np.bincount(at, minlength=k)
    # Chi-squared against uniform: its mean and variance if the token were text.
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    s2, s3 = float((freq ** 2).sum()), float((freq ** 3).sum())
    mean = k * ((n - 1) * s2 + 1) - n
    var = (k / n) ** 2 * 2 * n * (n - 1) * ((2 * n - 4) * (s3 - s2 * s2) + s2 - s2 * s2)
    z_chi = (mean - chi) / math.sqrt(max(var, 1e-9))
    # Runs of digits and letters: text changes class rarely.
    p = float(freq[digit].sum())
    is_digit = digit[at]
    changes = int((is_digit[1:] != is_digit[:-1]).sum())
    q = 2 * p * (1 - p)
    z_runs = (changes - (n - 1) * q) / math.sqrt(max((n - 1) * q * (1 - q), 0.25))
    # Serial correlation: text-like tokens repeat neighbours; take what exceeds chance as evidence against.
    x = at - at.mean()
    r = float((x[1:] * x[:-1]).sum() / max((x * x).sum(), 1e-9))
    z_serial = -abs(r) * math.sqrt(n) + math.sqrt(2 / math.pi)
    return 2 * z_chi + z_runs + z_serial


#: Tokens drawn per encoding and length class, and the longest class drawn (128 characters or more).
DRAWS, LAST_CLASS = 400, 8


@dataclass
class Null:
    """What tokens of text look like: ``shares`` of the characters of LETTERS, and
    from them the frequencies per encoding and the mean and deviation of
    :func:`statistics` per encoding and length class, from tokens drawn with a
    fixed seed (each with a letter and a digit, as candidates have)."""

    shares: np.ndarray
    freq: dict[str, np.ndarray] = field(init=False)
    digit: dict[str, np.ndarray] = field(init=False)
    moments: dict[tuple[str, int], tuple[float, float]] = field(init=False)

    def __post_init__(self) -> None:
        share = dict(zip(LETTERS, self.shares))
        both = {c: share[c.lower()] + share[c.upper()] if c.isalpha() else share[c] for c in LETTERS}
        self.freq, self.digit, self.moments = {}, {}, {}
        for name, alphabet in ENCODINGS.items():
            one_case = alphabet.lower() == alphabet or alphabet.upper() == alphabet
            f = np.array([(both if one_case else share)[c] for c in alphabet]) + 1e-9
            self.freq[name] = f / f.sum()
            self.digit[name] = np.array([c.isdigit() for c in alphabet])
            for size in range(5, LAST_CLASS + 1):
                sums = np.array([statistics(at, self.digit[name], self.freq[name]) for at in self.draw(name, max(20, 1 << (size - 1)), DRAWS)])
                self.moments[name, size] = (float(sums.mean()), float(sums.std()) or 1.0)

    def draw(self, name: str, length: int, n: int, seed: int = 7) -> np.ndarray:
        """``n`` tokens of text, as places in the alphabet."""
        rng = np.random.default_rng([seed, length, list(ENCODINGS).index(name)])
        f, digit = self.freq[name], self.digit[name]
        at = rng.choice(len(f), size=(n, length), p=f)
        letter = np.array([c.isalpha() for c in ENCODINGS[name]])
        place = rng.permuted(np.tile(np.arange(length), (n, 1)), axis=1)[:, :2]
        for column, kind in enumerate((digit, letter)):
            lacking = ~kind[at].any(axis=1)
            p = np.where(kind, f, 0)
            at[lacking, place[lacking, column]] = rng.choice(len(f), size=int(lacking.sum()), p=p / p.sum())
        return at


def battery(token: str, encoding: str, null: Null) -> float:
    """-log10 of the p-value against tokens of text; high for tokens far more uniform."""
    at = np.array([ENCODINGS[encoding].index(c) for c in token])
    mean, deviation = null.moments[encoding, min(len(token).bit_length(), LAST_CLASS)]
    z = (statistics(at, null.digit[encoding], null.freq[encoding]) - mean) / deviation
    return -math.log10(max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300))


def candidates(text: str, base: list[tuple[int, int, int]], null: Null) -> list[tuple[int, int, int, int]]:
    """``(start, end, length class, score)`` of the tokens outside the base spans
    that could be keys; the score is the battery's, in BINS per decade."""
    out = []
    for m in TOKEN.finditer(text):
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        encoding = encoding_of(m.group())
        if encoding:
            out.append((m.start(), m.end(), (m.end() - m.start()).bit_length(), int(battery(m.group(), encoding, null) * BINS)))
    return out


def all_spans(text: str, null: Null, limits: dict[int, int]) -> tuple[list, list]:
    """(base spans, base and added spans), each ``(start, kind, end)`` sorted."""
    base = base_spans(text)
    more = [(a, 3, b) for a, b, size, score in candidates(text, base, null) if size in limits and score >= limits[size]]
    return base, sorted(base + more)


def text_null(docs: DataFrame, text_col: str = "text") -> Null:
    """The null model: shares of the characters of LETTERS over all documents, tokens
    long enough to be keys left out (one bounded row set per task)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for part in slices(batches, "_text"):
            data = LONG.sub(b" ", b" ".join(pc.fill_null(part.column("_text"), "").cast(pa.binary()).to_pylist()))
            total += np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        codes = [ord(c) for c in LETTERS]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(total[codes])], names=["c", "n"])

    found = map_arrow(docs.select(docs[text_col].cast("string").alias("_text")), count, "c int, n long")
    by = {r["c"]: r["n"] for r in found.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # at most len(LETTERS) rows
    n = np.array([by.get(ord(c), 0) for c in LETTERS], dtype=np.float64) + 1
    return Null(n / n.sum())


def thresholds(docs: DataFrame, null: Null, level: float, text_col: str = "text") -> dict[int, int]:
    """Least score per length class (at most 64) that passes the discovery control over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches, "_text"):
            for text in pc.fill_null(part.column("_text"), "").to_pylist():
                seen.update((size, score) for _, _, size, score in candidates(text, base_spans(text), null))
        rows = [(size, score, n) for (size, score), n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))],
                                         names=["length_class", "score", "n"])

    counts = map_arrow(docs.select(docs[text_col].cast("string").alias("_text")), count, "length_class int, score int, n long")
    return {r["length_class"]: r["least"] for r in discoveries(counts, level).collect()}


def scan(docs: DataFrame, level: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, found`` per row: arrays of ``struct<start, kind, end>``
    (code points, end exclusive) of the patterns, and of all spans.

    ``level``: false-discovery rate of the added spans in a length class. A
    null text counts as empty; whole texts are scanned; repeated rows and null
    ids stay, each row for itself; other columns are ignored; an empty table
    gives an empty result.
    """
    null = text_null(docs, text_col)
    limits = thresholds(docs, null, level, text_col)
    src = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    spans = "array<struct<start:long,kind:int,end:long>>"
    shape = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            both = [all_spans(t, null, limits) for t in pc.fill_null(part.column("_text"), "").to_pylist()]
            arrays = [pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x[i]] for x in both], shape) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *arrays], names=["_id", "base", "found"])

    return map_arrow(src, find, f"_id {src.schema['_id'].dataType.simpleString()}, base {spans}, found {spans}").withColumnRenamed("_id", id_col)


def redacted(docs: DataFrame, level: float = 0.001, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (overlapping
    spans are one); null texts stay null, all other columns as they are."""
    null = text_null(docs, text_col)
    limits = thresholds(docs, null, level, text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = [None if t is None else redact(t, [(a, b) for a, _, b in all_spans(t, null, limits)[1]], mark)
                     for t in part.column(text_col).to_pylist()]
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.column(text_col).type))

    return map_arrow(docs, clean, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def discoveries(counts: DataFrame, level: float) -> DataFrame:
    """Benjamini-Hochberg per length class over counted p-values: the least
    score with (all tokens) * p(score) <= level * (tokens at or above it)."""
    binned = counts.groupBy("length_class", "score").agg(F.sum("n").alias("n"))
    upper = Window.partitionBy("length_class").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("length_class")
    p = F.pow(F.lit(10.0), -F.col("score") / BINS)
    ok = F.sum("n").over(every) * p <= level * F.sum("n").over(upper)
    return binned.withColumn("_ok", ok).where("_ok").groupBy("length_class").agg(F.min("score").alias("least"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every (start, end) replaced by ``mark``; overlapping spans are one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
