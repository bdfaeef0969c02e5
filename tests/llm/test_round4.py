"""Findings of round 3: work per word in the packing's tokeniser, memory of toxicity scoring."""

from __future__ import annotations

import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from dinerank.llm import packing, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_met_again_take_no_call_each():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = sorted({"".join(w) for w in rng.choice(letters, (6000, 9))})
    text = pa.array([" ".join(f"{w}," for w in words)], pa.large_string())
    coder = packing.WordIds(PATH)
    first = coder.texts(text)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        again = coder.texts(text)
    finally:
        sys.setprofile(None)
    assert calls < len(words)
    assert np.array_equal(first[0], again[0]) and np.array_equal(first[1], again[1])


def test_ids_of_odd_words_are_the_tokenizers():
    plain = [chr(c) for c in range(0x20, 0x260)]
    texts = ["", " ", "it's ''s \"'s can't CAN'T 12ab3 foo,foo <|endoftext|> x<|y Ⱥb ⱥb İs ß ẞ ŉa", "汉字 Привет x y z a\x0bb\x1cc\x85d",
             " ".join(plain), " ".join(f"a{c}B{c}{c}1" for c in plain), "".join(plain)]
    coder = packing.WordIds(PATH)
    for order in (texts, texts[::-1], [""]):
        ids, at = coder.texts(pa.array(order, pa.large_string()))
        for k, t in enumerate(order):
            assert ids[at[k]:at[k + 1]].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_scoring_a_long_text_holds_few_windows_at_once():
    net = toxicity.Network.fresh(toxicity.ToxicParams())
    text = pa.array([" ".join(f"w{k % 500}" for k in range(90_000))], pa.large_string())
    tracemalloc.start()
    try:
        score = net.score(text)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20, peak
    offsets, codes, words = toxicity._sequence(text)
    whole = net.logits(net.windows(offsets, codes)[0], net.project(net.inputs(words)[0]))
    assert np.allclose(score, 1 / (1 + np.exp(-whole.max())))
