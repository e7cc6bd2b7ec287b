"""Mixing, divergence audit and fill-in-middle against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratarisk.llm import divergence, fim, mix

SCHEMA = "doc_id long, text string, lang string, source string, size long, id long, key string, n long, form string, copies long, cells string, label double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 8, "k", 7, "f", 6, "c", 1.0) for r in rows], SCHEMA).repartition(3)


def word(rng):
    return "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    sources = ["b", "a", "Z", "é", "", None, "hot"]
    out = [(i, " ".join(word(rng) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(sources + ["hot"] * 4)) for i in range(160)]
    out += [(500, None, "en", "a"), (501, "", "fr", "only"), (502, " \t\n", "en", None), (None, "x Y z", None, "hot"), (None, "x Y z", None, "hot"), (None, None, None, None),
            (503, "tick tock " * 900, "en", "b"), (504, "one <S> two", "en", "a"), (505, "<<P", "en", "a"), (506, "Ünï CÖDÉ \x00 😀 zo", "en", "a")]
    out += [(600, out[0][1], out[0][2], "a")] * 5 + [(601 + k, out[1][1], out[1][2], "hot") for k in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def levelled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Excess over the limit reshared by weight until none is above."""
    named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in named if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in named}, named
        full |= over


def test_targets_and_quotas(spark):
    rng = random.Random(3)
    for k in range(4):
        sizes = {s: rng.choice([0, rng.randint(1, 50), rng.randint(1, 20000)]) for s in [None, "", "a", "Z", "é", "b", "c", "dd", "ab"][: 2 + 2 * k + 1]}
        sizes[None] = 5000
        t = mix.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        got = {r["source"]: r for r in t.collect()}
        want, named = levelled(sizes)
        assert all(got[s]["target"] == pytest.approx(want[s]) for s in sizes)
        block = got[None]["block"]
        assert {r["block"] for r in got.values()} == {block}
        house, shards = math.floor(1.5 * sum(sizes.values()) / block + 0.5), 5
        awards = sorted(((-got[s]["target"] / (2 * i + 1), named.index(s), i) for s in named if got[s]["target"] > 0 for i in range(house)))[:house]
        quotas = {(r["shard"], r["source"]): (r["first"], r["blocks"]) for r in mix.shard_quotas(t, shards).collect()}
        for j in range(shards):
            lo, hi = (collections.Counter(named[a[1]] for a in awards[: house * x // shards]) for x in (j, j + 1))
            assert {s: q for (x, s), q in quotas.items() if x == j} == {s: (lo[s], hi[s] - lo[s]) for s in named if got[s]["target"] > 0}


def test_mix(docs, rows):
    got = [r.asDict() for r in mix.mix_documents(docs, shards=3).collect()]
    same = lambda xs: collections.Counter((x["doc_id"], x["source"], x["size"], x["taken"]) for x in xs)
    assert same(got) == same(r.asDict() for r in mix.mix_documents(docs.repartition(7), shards=3).collect())
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == collections.Counter((i, s, len(words(t))) for i, t, _, s in rows)
    sizes = collections.Counter()
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
    want, _ = levelled(sizes)
    taken, by_shard = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(s["length"] for s in r["spans"])
        cover = collections.Counter(p for s in r["spans"] for p in range(s["at"], s["at"] + s["length"]))
        assert all(0 <= p < r["size"] and n <= 2 for p, n in cover.items())
        assert all(cover[p] - r["taken"] // max(1, r["size"]) in (0, 1, -1) for p in cover)
        taken[r["source"]] += r["taken"]
        for s in r["spans"]:
            by_shard[s["shard"]] += s["length"]
    block = max(1, min(4096, int(min(t for t in want.values() if t > 0) // 128)))
    assert all(abs(taken[s] - want[s]) <= 2 * block for s in sizes)
    assert max(by_shard.values()) - min(by_shard.values()) <= 8 * block


def test_mix_many_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(mix, "COPIES", 3)
    many = frame(spark, [(None, "a b c", "en", "s")] * 20 + [(1, "q " * 30, "en", "t"), (2, None, "en", "empty")])
    got = mix.mix_documents(many).collect()
    assert len(got) == 22 and sum(r["taken"] for r in got if r["source"] == "s") <= 120
    assert [(r["target"], r["taken"], r["spans"]) for r in got if r["source"] == "empty"] == [(0.0, 0, [])]
    assert mix.mix_documents(many.limit(0)).collect() == []
    blank = mix.mix_documents(frame(spark, [(1, None, None, None), (2, " ", None, "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2


def audit(rows, least):
    """The contract word by word, over every term of every group."""
    occ, df, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        occ[lang, source].update(found)
        occ[lang].update(found)
        df[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = shares(occ[lang, source]), shares(occ[lang])
        pairs = [(sum(f(p[t], o[t]) for t in kept), s) for la, s in groups if la == lang and s != source for o in [shares(occ[lang, s])]]
        terms = [(f(p[t], q[t]), t) for t in kept if occ[lang, source][t] and p[t] > q[t]]
        for part, found, top in (("pair", pairs, None), ("term", terms, 10)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:top])]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 10, 10000])
def test_divergence(docs, rows, least, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 7)
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "TEXT_BYTES", 300)
    got = divergence.source_divergence(docs, least_docs=least)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == audit(rows, least)


def test_divergence_edges(spark, docs):
    assert divergence.source_divergence(docs.limit(0)).collect() == []
    alone = frame(spark, [(1, "a b", "en", "s")] * 12)
    assert divergence.source_divergence(alone).collect() == []
    got = divergence.collapsed(docs).collect()
    assert len(got) == len({(r["lang"], r["text"]) for r in got})


def test_shares_are_exact_for_large_counts(spark):
    big = [(10 ** 15 + 7, 3 * 10 ** 15, 10 ** 7), (0, 0, 1), (0, 10 ** 16, 5)]
    got = spark.createDataFrame(big, "n long, total long, terms long").select(divergence._share("n", "total", "terms").alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10 ** 9 * (n + 2) // (t + 2 * v) for n, t, v in big]


def cut(doc_id, text):
    """Form, lengths and output by plain slicing."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("small", [False, True])
def test_fill_in_middle(spark, docs, rows, small, monkeypatch):
    if small:
        # segments of a few bytes: run in this process, as tasks do not see the change
        monkeypatch.setattr(fim, "SEGMENT_BYTES", 16)
        monkeypatch.setattr(fim, "GROUP_BYTES", 40)
        for i, t, _, _ in rows:
            n, form, lo, middle, out = cut(i, t)
            lo, hi = (n, n) if form == "plain" else (lo, lo + middle)
            batch = pa.RecordBatch.from_pydict({"id": [i], "text": [t or ""], "n": [n], "form": [form], "low": pa.array([lo], pa.int64()), "high": pa.array([hi], pa.int64())})
            made = next(iter(fim.transform([batch])))
            assert made.column(5)[0].as_py() == out
            assert fim.restore_texts(made.column(5), made.column(2))[0].as_py() == (t or "")
        return
    got = fim.restore(fim.fill_in_middle(docs)).collect()
    seen = collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got)
    assert seen == collections.Counter((i, *cut(i, t), t or "") for i, t, _, _ in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).collect() == []


def test_fill_in_middle_of_a_very_long_text(spark):
    text = "é😀 line\n" * 120_000
    rows = [(i, text, "en", "a") for i in range(4)]
    for r in fim.restore(fim.fill_in_middle(frame(spark, rows))).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut(r["doc_id"], text) and r["restored"] == text


def test_fill_in_middle_takes_any_id(spark, docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = {r["doc_id"]: r["output"] for r in fim.fill_in_middle(named).collect()}
    assert got["d503"] == cut("d503", "tick tock " * 900)[4]
