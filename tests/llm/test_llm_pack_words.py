"""Packing's encoder: words of letters encoded many at a time have the ids that each has by itself."""

import numpy as np

from stratarisk.llm import pack, registry


def test_words_are_told_apart_by_the_id_with_the_space():
    coder = pack.Encoder(registry.tokenizer_path())
    words = ["a", "ab", "house", "Straße", "naïve", "日本語", "ª", "ʰ", "xqzvkw", "ﬁ", "Ωmega", "İ"] * 3 + [f"w{'xyz'[i % 3] * (i % 7)}q" for i in range(2000)]
    words = [w for w in dict.fromkeys(words) if w.isalpha()]
    got = coder._ids_of_led(words)
    assert all(got[w] == np.asarray(coder.t.encode(" " + w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)
    assert coder.led.sum() > 100


def test_short_lists_and_arrays_partition_alike(monkeypatch):
    rng = np.random.default_rng(5)
    for windows in (1, 2, 7, 40):
        sizes = rng.integers(1, 513, 150)
        monkeypatch.setattr(pack, "FEW", 0)
        want = pack.differencing(sizes, windows)
        monkeypatch.setattr(pack, "FEW", 32)
        assert pack.differencing(sizes, windows) == want
