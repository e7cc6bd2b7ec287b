"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import time
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratarisk.llm import common, decontam, fingerprint, line_dedup, ngram_join, pack, quality, registry, shard, substring_dedup, url_filter, warc

SCHEMA = "doc_id long, text string, n long, sid string, doc long, line string, key string, row int, label double, lang string, source string"


def word(rng):
    return "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 7)))


def prose(rng, n, per_line=12):
    out = []
    for i in range(n):
        out.append(word(rng))
        out.append("\n" if i % per_line == per_line - 1 else " ")
    return "".join(out).strip()


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = word(rng)
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 160)) for _ in range(12)]
    shared = prose(rng, 50, 1000)
    out = []
    for i, t in enumerate(base):
        out.append((10 * i, t))
        out.append((10 * i + 1, changed(rng, t, 2)))
        out.append((10 * i + 2, t if i % 2 else changed(rng, t, 9)))
        out.append((10 * i + 3, prose(rng, 40) + "\n" + shared + "\n" + prose(rng, 20)))
    out += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "One"), (505, "a b c d"), (506, "a  b c \n d"), (507, "tick " * 400),
            (508, prose(rng, 20000)), (None, "x y z x y z x y z"), (None, None), (600, base[0]), (600, base[0]), (601, "Ünï cödé \u00a0 wörds  \n \n und mehr")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2, "l", "k", 3, 1.0, "en", None) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(1, "x")]).where("false")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- sharding --------------------------------------------------------------

def test_shards(spark, docs, rows, empty):
    got = shard.shard_documents(docs, 8).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    assert shard.shard_documents(empty).collect() == []


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(1)
    hot = prose(rng, 40)
    rows = [(i, hot if i % 20 == 0 else prose(rng, rng.randint(5, 60))) for i in range(3000)]
    got = shard.shard_documents(frame(spark, rows), 4).collect()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.03 * min(size.values())
    text = dict(rows)
    where = collections.defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_group_larger_than_a_shard_is_subdivided(spark):
    rows = [(i, "same text all over" if i % 2 else f"other {i}") for i in range(2000)]
    size = collections.Counter()
    for r in shard.shard_documents(frame(spark, rows), 8).collect():
        size[r["shard"]] += r["size"]
    assert len(size) == 8 and max(size.values()) < 1.15 * min(size.values())


# --- line dedup ------------------------------------------------------------

def late_lines(rows):
    """Numbers of repeated lines by id; rows that share an id are one document."""
    kept, out, counted = [], collections.defaultdict(set), collections.defaultdict(set)
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            w = frozenset(tokens(line))
            if not w:
                continue
            counted[i].add(k)
            if any(5 * len(w & v) >= 4 * len(w | v) for v in kept):
                out[i].add(k)
            kept.append(w)
    return out, counted


@pytest.mark.parametrize("tight", [False, True])
def test_lines(docs, rows, empty, tight, monkeypatch):
    if tight:  # the exact look at everything, long lists and pair listings
        for name, v in (("HOT_LIST", 3), ("HOT_FIRST", 1), ("FREQUENT", 2)):
            monkeypatch.setattr(line_dedup, name, v)
    late, counted = late_lines(rows)
    got = line_dedup.line_report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert set(r["removed"]) == late[r["doc_id"]] and r["n_removed"] == len(r["removed"]), r["doc_id"]
    own = collections.Counter((i, sum(bool(tokens(x)) for x in (t or "").split("\n"))) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_lines"]) for r in got) == own
    assert line_dedup.line_report(empty).collect() == []


def test_lines_cut(docs, rows, empty):
    late, counted = late_lines(rows)
    got = line_dedup.remove_lines(docs).collect()
    want = []
    for i, t in rows:
        if counted[i] and counted[i] == late[i]:
            continue
        want.append((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in late[i])))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, want))
    assert got[0]["sid"] == "s" and line_dedup.remove_lines(empty).columns == empty.columns


def test_cutting_lines_from_a_very_long_text(spark):
    rng = random.Random(31)
    fresh = [f"{word(rng)} line number {i} of the long text {i * 7919}" for i in range(60_000)]
    lines = [x for f in fresh for x in (f, "the same words in every second line")]
    rows = [(1, "the same words in every second line"), (2, "\n".join(lines)), (3, None), (4, "")]
    start = time.time()
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(frame(spark, rows)).collect()}
    kept = got[2].split("\n")
    assert len(kept) == len(set(kept)) and set(kept) <= set(fresh) and got[3] is None and got[4] == ""
    assert time.time() - start < 90


def test_line_variants_meet(spark):
    rng = random.Random(9)
    base = [word(rng) for _ in range(30)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(30)] = word(rng)
        rows.append((i, " ".join(w)))
    late, _ = late_lines(rows)
    got = {r["doc_id"]: set(r["removed"]) for r in line_dedup.line_report(frame(spark, rows)).collect()}
    assert got == {i: late[i] for i, _ in rows}


@pytest.mark.parametrize("tight", [False, True])
def test_lines_of_rows_that_share_an_id(spark, tight, monkeypatch):
    if tight:
        for name, v in (("HOT_LIST", 3), ("HOT_FIRST", 1), ("FREQUENT", 2)):
            monkeypatch.setattr(line_dedup, name, v)
    rng = random.Random(21)
    lines = [prose(rng, 12, 1000) for _ in range(12)]
    near = lines[0] + " besides"
    # of the rows without an id, and of those with id 7, one repeats a line as it is and one nearly; all others are unlike
    rows = [(None, lines[0] + "\n" + lines[1]), (None, lines[2]), (None, lines[3] + "\n" + lines[4]), (None, None), (None, lines[5]), (None, lines[5]),
            (7, lines[0]), (7, lines[6] + "\n" + lines[7]), (7, near + "\n" + lines[8]), (7, lines[9]), (8, lines[6]), (8, lines[10]), (9, lines[11])]
    want = [lines[0] + "\n" + lines[1], lines[2], lines[3] + "\n" + lines[4], None, lines[5], lines[5],
            lines[6] + "\n" + lines[7], lines[8], lines[9], lines[10], lines[11]]
    got = line_dedup.remove_lines(frame(spark, rows)).collect()
    assert sorted(str(r["text"]) for r in got) == sorted(map(str, want))
    report = line_dedup.line_report(frame(spark, rows)).collect()
    assert len(report) == len(rows) and sorted((r["doc_id"], *r["removed"]) for r in report if r["removed"]) == [(7, 0), (7, 0), (8, 0)]


# --- substring dedup -------------------------------------------------------

def test_substrings(docs, rows, empty):
    seen = collections.Counter(tuple(w[i: i + 35]) for w in (tokens(t) for _, t in rows) for i in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = tokens(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k: k + 35])] > 1:
                gone[k: k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, want))
    assert any(r["n_removed"] for r in got)
    for r in got:
        s = r["spans"]
        assert sum(b - a for a, b in zip(s[::2], s[1::2])) == r["n_removed"] and all(b - a >= 35 for a, b in zip(s[::2], s[1::2]))
    assert substring_dedup.remove_repeats(empty).collect() == []


# --- URL filter ------------------------------------------------------------

URLS = [(1, "http://a.example.net/en/1?x=1"), (2, "https://WWW.Example.COM/de/2#t"), (3, "http://example.org/fr/"), (4, "http://notnet/x"), (5, None), (6, "no scheme"),
        (7, ""), (8, "http://net"), (9, "http://net/"), (10, "http://a.net/fr/?q#f"), (11, "x://y://z/p"), (12, "http://b.org?/fr/"), (13, "http://myexample.net/en/1"), (1, "http://a.example.net/en/1?x=1")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, says in registry.URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, best


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1.0, "x") for i, u in URLS], "page_id long, url string, host string, score double, rule string")
    got = url_filter.judge_urls(pages, registry.URL_RULES).collect()
    assert len(got) == len(URLS)
    want = collections.Counter()
    for i, u in URLS:
        host, path, best = judged(u)
        want[(i, host, path, best and best[0])] += 1
    assert collections.Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    for r in got:
        best = judged(dict(URLS)[r["page_id"]])[2]
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(pages.where("false"), registry.URL_RULES).collect() == []


def test_url_trees_learn(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.4
        host = f"{word(rng)}.{rng.choice(['biz', 'top'] if bad and rng.random() < .8 else ['org', 'com'])}"
        rows.append((i, f"http://{host}/{word(rng)}" + (f"?{word(rng)}={rng.randint(1, 99999)}&b={rng.randint(1, 99999)}" if bad else f"/{word(rng)}.html"), float(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label double")
    train, test = df.where("page_id < 1000"), df.where("page_id >= 1000")
    got = url_filter.judge_urls(test, [], labelled=train).join(df.select("page_id", "label"), "page_id").collect()
    assert np.mean([(r["verdict"] == "block") == (r["label"] == 1.0) for r in got]) > 0.95


# --- decontamination -------------------------------------------------------

def test_leaks(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randint(16, 60), 1000)) for i in range(30)]
    clean = [(i, prose(rng, rng.randint(5, 400))) for i in range(200)]
    exact = [(1000 + i, prose(rng, rng.randint(0, 300)) + "\n" + t.upper() + ", " + prose(rng, 50)) for i, t in items]
    para = [(2000 + i, prose(rng, 100) + " " + changed(rng, t, len(t.split()) // 6) + " " + prose(rng, 70)) for i, t in items]
    docs = spark.createDataFrame([(*r, 1, "x") for r in clean + exact + para + [(3000, None), (3001, ""), (None, items[0][1]), (3002, items[1][1]), (3002, items[1][1])]],
                                 "doc_id long, text string, lcs long, item_id string").repartition(4)
    bench = spark.createDataFrame([*items, (90, None), (91, " ")], "item_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect())
    assert got == collections.Counter([(1000 + i, i) for i, _ in items] + [(2000 + i, i) for i, _ in items] + [(None, 0), (3002, 1), (3002, 1)])
    left = decontam.drop_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == 202
    assert decontam.find_leaks(docs.where("false"), bench).collect() == []
    assert decontam.find_leaks(docs, bench.where("false")).collect() == []


def every_block(docs, bench):
    """The rule of find_leaks over every block of every text and every item, without any search."""
    out = {}
    for i, text in docs:
        w = plain(text)
        words = set(w)
        for j, item in bench:
            u = plain(item)
            bits = {}
            for k, x in enumerate(u):
                bits[x] = bits.get(x, 0) | 1 << k
            if len(u) and 2 * sum(x in words for x in u) < len(u):
                continue
            for b in range(0, len(w), 16) if u else ():
                near = w[max(0, b - len(u)): b + 32 + len(u)]
                some = set(near)
                if 2 * sum(x in some for x in u) < len(u):
                    continue
                lcs = decontam.lcs_length(bits, len(u), near)
                told = any(near[k: k + len(u[-5:])] == u[-5:] for k in range(len(near)))
                if lcs >= 0.7 * len(u) or (told and lcs >= 0.5 * len(u)):
                    out[i, j] = max(out.get((i, j), 0), lcs)
    return out


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def planted_leaks(docs, bench, share, seed, first_id):
    """Every item, ``share`` of its words replaced by words of the text around it, within a text that is not its own."""
    rng, out = random.Random(seed), []
    hosts = [t.split() for _, t in docs if t and 40 <= len(t.split()) <= 400]
    for k, (_, item) in enumerate(bench):
        host, w = rng.choice(hosts), item.split()
        for i in rng.sample(range(len(w)), round(share * len(w))):
            w[i] = rng.choice(host)
        at = rng.randrange(len(host))
        out.append((first_id + k, " ".join(host[:at] + w + host[at:])))
    return out


def test_leaks_as_by_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    docs = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    bench = [tuple(r) for r in common.table(spark, sf, "benchmark").orderBy("item_id").collect()]
    planted = planted_leaks(docs, bench, 0.2, 1, 10 ** 6) + planted_leaks(docs, bench, 0.3, 2, 2 * 10 ** 6)
    want = every_block(planted, bench)
    assert len(want) >= 300
    every = common.table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    found = decontam.find_leaks(every, common.table(spark, sf, "benchmark")).where("doc_id >= 1000000").collect()
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in found}
    print(*(f"{n}: found {sum(k in got for k in part)} of {len(part)}" for n, part in
            (("20%", [k for k in want if k[0] < 2 * 10 ** 6]), ("30%", [k for k in want if k[0] >= 2 * 10 ** 6]))))
    assert got == want


def test_lcs():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 70))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        bits = {}
        for k, x in enumerate(a):
            bits[x] = bits.get(x, 0) | 1 << k
        assert decontam.lcs_length(bits, len(a), b) == t[-1][-1]


# --- packing ---------------------------------------------------------------

def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(registry.tokenizer_path())
    t.encode_special_tokens = True
    got = pack.pack_documents(docs, registry.tokenizer_path(), with_ids=True, group=16).collect()
    made = collections.Counter()
    seqs, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[(r["doc_id"], r["doc_tokens"])].append((r["start"], tuple(ids)))
    for v in seqs.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 2048
    for (i, n), v in parts.items():
        whole = [x for _, ids in sorted(v) for x in ids]
        made[(i, n)] = len(whole) // n
    want = collections.Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[(i, len(ids))] += 1
        if want[(i, len(ids))] == 1 and i is not None and i != 600:
            assert [x for _, p in sorted(parts[(i, len(ids))]) for x in p] == ids
    assert made == want
    assert pack.pack_documents(empty, registry.tokenizer_path()).collect() == []


def test_differencing():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 512, 700)
    bins = pack.windows_of(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(700))
    sums = [int(sizes[b].sum()) for b in bins]
    assert max(sums) <= 2048 and sum(sums) / (2048 * len(bins)) > 0.95
    assert pack.differencing(np.array([8, 7, 6, 5, 4]), 2) in ([[0, 3], [1, 2, 4]], [[1, 2, 4], [0, 3]], [[0, 2], [1, 3, 4]], [[1, 3, 4], [0, 2]])
    assert pack.windows_of(np.array([2048, 2048, 1]), 2048) and pack.windows_of(np.zeros(0, np.int64), 2048) == []


def test_encoder_matches_whole_text():
    rng = random.Random(8)
    coder = pack.encoder(registry.tokenizer_path())
    texts = ["".join(rng.choice(["a", "the", " ", " ", "  ", "\n", "\t", ".", "é", "\u00a0", "12", "'s", "<|endoftext|>"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in coder.t.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want


def test_added_tokens_as_by_the_file(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(registry.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one two<|endoftext|>three  four", "x <|endoftext|><|endoftext|>\n", "<|endoftext|", "a <| endoftext |> b", "no such thing, at all."]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u4").tolist() for x in pack.encoder(registry.tokenizer_path()).encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pack.pack_documents(docs, registry.tokenizer_path(), with_ids=True).collect()}
    for i, ids in enumerate(want):
        raw = np.array([*ids, 1], "<u4").tobytes()
        assert (got[i]["ids"], got[i]["ids_crc32"], got[i]["doc_tokens"]) == (raw, zlib.crc32(raw), len(ids) + 1)


# --- revisits --------------------------------------------------------------

def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_PER_SPAN", 20)
    rng = random.Random(6)
    recs = []
    for i in range(400):
        url = rng.choice(["http://H.com", "http://h.com:80/", "HTTP://h.com/#f", "https://h.com:443/a?b=1", "https://h.com/a?b=1", "http://h.com/x#y", "nourl", None])
        kind = rng.choice(["response", "revisit"])
        recs.append((i, url, rng.choice([None, *range(0, 60)]), kind, rng.choice([200, 200, 404]) if kind == "response" else 304, rng.choice([None, '"a"', 'W/"a"', '"b"']),
                     rng.choice([None, "m1", "m2"]), rng.choice([None, "d1"]), {"date": str(i), "content-type": f"t{i}", "x": "1"} if i % 9 else None, "extra"))
    df = spark.createDataFrame(recs, "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, canon string")

    def canon(u):
        return None if u is None or "://" not in u else {"http://H.com": "http://h.com/", "http://h.com:80/": "http://h.com/", "HTTP://h.com/#f": "http://h.com/",
                                                         "https://h.com:443/a?b=1": "https://h.com/a?b=1", "http://h.com/x#y": "http://h.com/x"}.get(u, u)

    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    revisits = [r for r in recs if r[3] == "revisit"]
    assert len(got) == len(revisits)
    for r in revisits:
        c = canon(r[1])
        before = [q for q in recs if q[3] == "response" and q[4] == 200 and c and canon(q[1]) == c and None not in (q[2], r[2]) and q[2] < r[2]]
        g = got[r[0]]
        assert g["canon"] == c
        if not before:
            assert g["outcome"] == "missing"
            continue
        q = max(before, key=lambda q: (q[2], q[0]))
        bare = lambda e: e.removeprefix("W/")
        ok = bare(r[5]) == bare(q[5]) if r[5] and q[5] else r[6] == q[6] if r[6] and q[6] else True
        ok = ok and not (r[7] and q[7] and r[7] != q[7])
        assert g["outcome"] == ("resolved" if ok else "changed"), (r, q)
        if ok:
            assert g["response_id"] == q[0] and g["digest"] == q[7]
            assert g["headers"] == {**(q[8] or {}), **{k: v for k, v in (r[8] or {}).items() if k != "content-type"}}
    assert warc.resolve_revisits(df.where("false")).collect() == []


# --- quality ---------------------------------------------------------------

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = quality.score_documents(docs, train).join(test, "doc_id").select("quality", "keep").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_quality_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1), (10, 1), (507, 0), (None, 1), (20, None), (501, 0), (30, 1), (30, 0)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_documents(empty, labels).collect() == []
    none = quality.keep_good(docs, labels.where("false"))
    assert none.count() == len(rows) and none.columns == docs.columns
    one = quality.keep_good(docs, labels.where("quality = 1"))
    assert one.count() == len(rows)


# --- n-gram join -----------------------------------------------------------

def shingles(text):
    w = tokens("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def test_ngram_join(docs, rows, empty):
    got = ngram_join.ngram_jaccard_join(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, linked_components(rows)))
    assert ngram_join.ngram_jaccard_join(empty).collect() == []
    stay = ngram_join.one_per_group(docs)
    assert stay.columns == docs.columns
    linked = linked_components(rows)
    kept = sorted([str(i) for i, n, c in linked if not n] + [str(c) for c in {c for i, n, c in linked if n and c is not None}]
                  + ["None" for t in {t for (i, n, c), (_, t) in zip(linked, rows) if n and c is None}])
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == kept


def test_one_row_of_a_group_stays_and_no_other_goes(spark):
    rng = random.Random(4)
    long, other = prose(rng, 80), prose(rng, 60)
    near = changed(rng, long, 1)
    given = [(1, long), (1, long), (2, long), (None, long), (3, other), (3, near), (None, "a lone row without an id"), (4, None), (4, None), (5, " ")]
    got = ngram_join.one_per_group(frame(spark, given))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(1, long), (3, other), (None, "a lone row without an id"), (4, None), (4, None), (5, " ")], key=str)
    nameless = ngram_join.one_per_group(frame(spark, [(None, long), (None, near), (None, near), (None, other)])).collect()
    assert len(nameless) == 2 and {r["text"] for r in nameless} - {long, near} == {other}


def test_ngram_chains(spark):
    rng = random.Random(12)
    rows, text = [], [word(rng) for _ in range(120)]
    for i in range(60):  # each near the one before, the ends far apart
        rows.append((1000 - i, " ".join(text)))
        text = list(text)
        text[rng.randrange(120)] = word(rng)
    rows += [(i, prose(rng, 120)) for i in range(40)]
    got = ngram_join.ngram_jaccard_join(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(linked_components(rows))


# --- fingerprints ----------------------------------------------------------

def test_marks_are_rightmost_minima(docs):
    grams = fingerprint.gram_hashes(fingerprint.words_of(F.coalesce("text", F.lit(""))), 5)
    for r in docs.select("text", grams.alias("g"), fingerprint.winnow(F.col("text"))["positions"].alias("p")).collect():
        g, n = r["g"], len(tokens(r["text"]))
        assert len(g) == (0 if not n else max(1, n - 4))
        g = [v >> 32 for v in g]
        want = []
        for s in range(max(0, len(g) - 8) + 1 if g else 0):
            win = g[s: s + 8]
            k = s + max(i for i, v in enumerate(win) if v == min(win))
            if k not in want:
                want.append(k)
        assert r["p"] == want


def test_neighbours(docs, rows, empty):
    got = fingerprint.fingerprint_neighbours(docs).collect()
    assert len(got) == len(rows)
    alone = [(i, t) for i, t in rows if i is not None and i != 600]
    order = sorted({(i, t or "") for i, t in rows if i is not None}, reverse=True)
    after = {i: order[k + 1][1] for k, (i, _) in enumerate(order[:-1])}
    by = {r["doc_id"]: r for r in got}
    for i, t in alone:
        if i not in after:
            continue
        t = t or ""
        n = len(t)
        edited = t[: n - n // 3] + after[i][: n // 3]
        assert by[i]["n_chars"] == n and by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= by[i]["near_edited"] <= 1 and 0 <= by[i]["near_next"] <= 1
    assert by[10]["fingerprint"] == by[12]["fingerprint"] and by[507]["near_next"] == 0 and by[502]["near_next"] == 1
    assert fingerprint.fingerprint_neighbours(empty).collect() == []
    one = fingerprint.fingerprint_neighbours(docs.where("doc_id = 0")).collect()[0]
    assert one["near_next"] == 1.0


# --- helpers ---------------------------------------------------------------

def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7)]
    up = list(range(400))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
