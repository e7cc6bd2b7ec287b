"""Benchmark decontamination by latent semantic retrieval.

Passages (runs of words) of all documents are TF-IDF vectors over the rarer
words of the benchmark. A distributed randomised SVD gives their latent space: every
task adds its passages to the range sketch A'(A Omega), and the driver, which
sees that matrix only, takes the singular vectors from it. Passages are searched
by cosine in that space; a candidate is then compared word by word: the longest
common subsequence with the item must be long, or fairly long with the item's
answer (its last words) standing in the document as they are.

Beside the cosine stands a way that loses nothing by that comparison. A long
subsequence leaves out few of an item's words, so some of its rarest ones stand
in the window (prefix filter on counts); and a fairly long one comes with the
answer, which is looked up as it is. Windows found either way are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
PASSAGE, STRIDE = 32, 16
#: a sixteenth of the terms is the rank, at least RANK, as long as terms x rank stay within CELLS (128 MB); EXTRA columns more are drawn
RANK, TERMS_A_RANK, CELLS, EXTRA = 64, 16, 1 << 24, 16
#: rarest words of an item that a window must have, beyond those that a long subsequence may leave out
RARE_HITS = 3
SLOT_BITS = 18
#: a word of the benchmark is a term if it is in at most this share of the passages, or among the rarest words of an item
RARE, OWN_WORDS = 0.002, 8
#: terms that a passage of one block must have to be searched
MIN_TERMS = 2
COSINE, FAR, NEAR, ANSWER_WORDS = 0.5, 0.7, 0.5, 5
#: benchmark items that are searched at once
BLOCK_ITEMS = 20_000

PLAIN = C.LOWER.copy()
for _c in range(33, 127):
    if not chr(_c).isalnum():
        PLAIN[_c] = 32


def plain_words(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, word hashes): A-Z lower-cased, ASCII punctuation as white space."""
    b = PLAIN[raw]
    s, e, row = C.words(off, b)
    return C.by_row(row, len(off) - 1), C.span_hashes(b, s, e)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - SLOT_BITS)).astype(np.int64)


def _summed(df: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all tasks of the matrix that make(batches) gives; added up by blocks of rows."""
    rows = 256

    def run(batches):
        m = make(batches)
        for i in range(0, len(m), rows):
            yield pa.RecordBatch.from_arrays([pa.array([i // rows], pa.int32()), pa.array([m[i: i + rows].tobytes()], pa.binary())], names=["part", "m"])

    def add(batches):
        part, total = None, None
        for x in batches:
            for p, m in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                m = np.frombuffer(m, np.float64)
                if p != part:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])
                    part, total = p, m.copy()
                else:
                    total += m
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    got = df.mapInArrow(run, "part int, m binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, m binary").collect()
    out = np.zeros(shape)
    for r in got:
        m = np.frombuffer(r["m"], np.float64).reshape(-1, shape[1])
        out[r["part"] * rows: r["part"] * rows + len(m)] = m
    return out


def _passages(at: np.ndarray, feature: np.ndarray):
    """Passages that follow one another without overlap: (passage of each known word, its feature, number of passages)."""
    n = np.diff(at)
    count = -(-n // PASSAGE)
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), n)
    passage = first[row] + (np.arange(len(row)) - at[row]) // PASSAGE
    known = feature >= 0
    return passage[known], feature[known], int(first[-1])


def _entries(passage: np.ndarray, feature: np.ndarray):
    """Distinct (passage, feature) with counts, in order."""
    key, tf = np.unique(passage * (1 << 32) + feature, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf.astype(np.float64)


def _weights(passage, feature, tf, idf, n):
    """TF-IDF entries with each passage scaled to length 1."""
    w = (1 + np.log(tf)) * idf[feature]
    norm = np.sqrt(np.bincount(passage, w * w, n))
    return w / np.maximum(norm[passage], 1e-12)


def lcs_length(bits: dict[int, int], size: int, words: list[int]) -> int:
    """Longest common subsequence of a pattern of ``size`` words (bits: positions of each word) and ``words``, by bit vectors."""
    full = (1 << size) - 1
    v = full
    for w in words:
        u = v & bits.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Postings:
    """(word, item, value) by word, with a table of slots before the words themselves."""

    def __init__(self, rows: list):
        rows.sort()
        word = np.array([r[0] for r in rows], U64)
        self.item, self.value = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.word, first = np.unique(word, return_index=True)
        self.bounds = np.append(first, len(rows))
        self.slot = np.zeros(1 << SLOT_BITS, bool)
        self.slot[_slots(self.word)] = True

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, value) of every posting of the words ``h``."""
        pos = np.flatnonzero(self.slot[_slots(h)])
        at = np.minimum(np.searchsorted(self.word, h[pos]), len(self.word) - 1)
        keep = self.word[at] == h[pos]
        pos, at = pos[keep], at[keep]
        n = self.bounds[at + 1] - self.bounds[at]
        k = np.repeat(self.bounds[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(pos, n), self.item[k], self.value[k]


class Space:
    """The latent space of one block of benchmark items, as every task gets it."""

    def __init__(self, ids: list, at: np.ndarray, h: np.ndarray):
        self.ids, self.at, self.h = ids, at, h
        slots = np.unique(_slots(h))
        self.feature = np.full(1 << SLOT_BITS, -1, np.int32)
        self.feature[slots] = np.arange(len(slots))
        self.size = len(slots)
        self.idf = self.v = self.owner = self.start = self.z = None
        self.rare = self.told = None

    def keep(self, chosen: np.ndarray) -> None:
        """Only the chosen features stay."""
        place = np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)
        self.feature = np.where(self.feature >= 0, place[np.maximum(self.feature, 0)], -1).astype(np.int32)
        self.size = int(chosen.sum())

    def features_of(self, h: np.ndarray) -> np.ndarray:
        return self.feature[_slots(h)].astype(np.int64)

    def look_up(self, seen: np.ndarray) -> None:
        """Postings of the lossless way. seen: passages that have each feature, before any is left out.

        Of an item's n words FAR * n must stand in a window in their order, so
        of its n - FAR * n + k rarest at least k do, whatever else is changed.
        """
        rare, told = [], []
        self.least = np.zeros(len(self.ids), np.int64)
        for i in range(len(self.ids)):
            h = self.h[self.at[i]: self.at[i + 1]]
            n, often = len(h), seen[self.features_of(h)]
            if not n:
                continue
            spare = n - int(np.ceil(FAR * n))
            self.least[i] = min(n, spare + RARE_HITS) - spare
            word, weight = np.unique(h[np.lexsort((h, often))[: spare + self.least[i]]], return_counts=True)
            rare += zip(word.tolist(), [i] * len(word), weight.tolist())
            k = max(0, n - ANSWER_WORDS)
            told.append((int(h[k + int(np.argmin(often[k:]))]), i, int(np.argmin(often[k:]))))
        self.rare, self.told = Postings(rare), Postings(told)

    def windows(self, at: np.ndarray, h: np.ndarray) -> set:
        """(row, block, item) of the windows that may match: a superset of those that do, by counts and answers alone."""
        size = np.diff(self.at)
        first, last, item = [], [], []
        pos, who, weight = self.rare.places(h)
        if len(pos):
            row = np.searchsorted(at, pos, "right") - 1
            order = np.lexsort((pos, row, who))
            order = np.repeat(order, weight[order])
            pos, who, row = pos[order], who[order], row[order]
            other = np.arange(len(pos)) + self.least[who] - 1
            i = np.flatnonzero(other < len(pos))
            j = other[i]
            i, j = (x[(who[i] == who[j]) & (row[i] == row[j]) & (pos[j] - pos[i] < PASSAGE + 2 * size[who[i]])] for x in (i, j))
            first.append(pos[i]), last.append(pos[j]), item.append(who[i])
        pos, who, offset = self.told.places(h)
        if len(pos):
            row = np.searchsorted(at, pos, "right") - 1
            n = np.minimum(size[who], ANSWER_WORDS)
            begin = pos - offset
            ok = (begin >= at[row]) & (begin + n <= at[row + 1])
            begin, who, n = begin[ok], who[ok], n[ok]
            ok = np.ones(len(begin), bool)
            for k in range(ANSWER_WORDS):
                has = np.flatnonzero(ok & (k < n))
                ok[has] = h[begin[has] + k] == self.h[self.at[who[has] + 1] - n[has] + k]
            first.append(begin[ok]), last.append((begin + n - 1)[ok]), item.append(who[ok])
        if not first:
            return set()
        first, last, item = (np.concatenate(x) for x in (first, last, item))
        row = np.searchsorted(at, first, "right") - 1
        # all blocks whose windows have both places
        a, b = first - at[row], last - at[row]
        lo = np.maximum(0, -((PASSAGE - 1 + size[item] - b) // STRIDE))
        hi = np.minimum((a + size[item]) // STRIDE, -(-np.diff(at)[row] // STRIDE) - 1)
        n = np.maximum(hi - lo + 1, 0)
        block = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return set(zip(np.repeat(row, n).tolist(), block.tolist(), np.repeat(item, n).tolist()))

    def search(self, v: np.ndarray) -> None:
        """Latent vectors of the items' own passages."""
        self.v = v.astype(np.float32)
        owner, rows, cols, count = [], [], [], 0
        for i in range(len(self.ids)):
            h = self.h[self.at[i]: self.at[i + 1]]
            for s in range(0, max(1, len(h) - PASSAGE + STRIDE), STRIDE):
                f = self.features_of(h[s: s + PASSAGE])
                f = f[f >= 0]
                owner.append(i)
                rows.append(np.full(len(f), count))
                cols.append(f)
                count += 1
        passage, feature, tf = _entries(np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64),) * 3
        w = _weights(passage, feature, np.asarray(tf, float), self.idf, count)
        z = np.zeros((count, self.v.shape[1]))
        np.add.at(z, passage, self.v[feature] * w[:, None])
        norm = np.linalg.norm(z, axis=1)
        ok = norm > 1e-9
        self.owner, self.z = np.array(owner, np.int64)[ok], (z[ok] / norm[ok, None]).astype(np.float32)
        self.bits = []
        for i in range(len(self.ids)):
            bits: dict[int, int] = {}
            for k, w_ in enumerate(self.h[self.at[i]: self.at[i + 1]].tolist()):
                bits[w_] = bits.get(w_, 0) | 1 << k
            self.bits.append(bits)
        self.answers = [tuple(self.h[max(self.at[i], self.at[i + 1] - ANSWER_WORDS): self.at[i + 1]].tolist()) for i in range(len(self.ids))]

    def latent(self, at: np.ndarray, h: np.ndarray) -> set:
        """(row, block, item) of the passages near an item by cosine."""
        if not len(self.z):
            return set()
        feature = self.features_of(h)
        known = np.flatnonzero(feature >= 0)
        if not len(known):
            return set()
        n = np.diff(at)
        blocks = -(-n // STRIDE)
        first = np.concatenate([[0], np.cumsum(blocks)])
        row = np.searchsorted(at, known, "right") - 1
        block = first[row] + (known - at[row]) // STRIDE
        kb = block
        head = np.flatnonzero(np.concatenate([[True], kb[1:] != kb[:-1]]))
        y = np.add.reduceat(self.v[feature[known]] * self.idf[feature[known]].astype(np.float32)[:, None], head)
        terms, live = np.diff(np.append(head, len(kb))), kb[head]
        owner_row = np.searchsorted(first, live, "right") - 1
        # passages of one block and of two: a short item is a small part of the longer ones
        one = np.flatnonzero(terms >= MIN_TERMS)
        two = np.flatnonzero((live[1:] == live[:-1] + 1) & (owner_row[1:] == owner_row[:-1]))
        z = np.concatenate([y[one], y[two] + y[two + 1]])
        place = np.concatenate([one, two])
        norm = np.linalg.norm(z, axis=1)
        z, place = z[norm > 1e-6] / norm[norm > 1e-6, None], place[norm > 1e-6]
        out: set = set()
        for i in range(0, len(z), 4096):
            p, q = np.nonzero(z[i: i + 4096] @ self.z.T >= COSINE)
            b = place[i + p]
            out.update(zip(owner_row[b].tolist(), (live[b] - first[owner_row[b]]).tolist(), self.owner[q].tolist()))
        return out

    def found(self, at: np.ndarray, h: np.ndarray):
        """(row, item, lcs, answer) of the matches in the rows of a slice."""
        if not len(h):
            return []
        got: dict = {}
        for r, b, item in sorted(self.latent(at, h) | self.windows(at, h)):
            size = int(self.at[item + 1] - self.at[item])
            lo = max(int(at[r]), int(at[r]) + b * STRIDE - size)
            hi = min(int(at[r + 1]), int(at[r]) + b * STRIDE + PASSAGE + size)
            near = h[lo:hi].tolist()
            bits = self.bits[item]
            if sum(bits[w].bit_count() for w in bits.keys() & set(near)) < NEAR * size:
                continue
            lcs = lcs_length(bits, size, near)
            if lcs < NEAR * size or lcs <= got.get((r, item), (0, False))[0]:
                continue
            answer = self.answers[item]
            told = any(tuple(near[k: k + len(answer)]) == answer for k in range(len(near) - len(answer) + 1))
            if lcs >= FAR * size or told:
                got[(r, item)] = (lcs, told)
        return [(r, item, lcs, told) for (r, item), (lcs, told) in sorted(got.items())]


def latent_space(texts: DataFrame, items: list, seed: int = 7) -> Space | None:
    """The space of the given items (id, text), fitted on all ``texts`` (one column)."""
    items = [(i, t) for i, t in items if t and t.strip()]
    raw = [t.encode() for _, t in items]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    at, h = plain_words(off, np.frombuffer(b"".join(raw), np.uint8))
    space = Space([i for i, _ in items], at, h)
    if not len(h):
        return None
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(space)
    d = space.size

    def slices(batches, s):
        for x in batches:
            for _, off, raw in C.slices(x.column(0)):
                at, h = plain_words(off, raw)
                yield _passages(at, s.features_of(h))

    def frequencies(batches):
        out = np.zeros((d + 1, 1))
        for passage, feature, n in slices(batches, shared.value):
            _, f, _ = _entries(passage, feature)
            out[:d, 0] += np.bincount(f, minlength=d)
            out[d] += n
        return out

    seen = _summed(texts, frequencies, (d + 1, 1))[:, 0]
    total, seen = seen[-1], seen[:-1]
    space.look_up(seen)
    chosen = seen <= max(2.0, RARE * total)
    for i in range(len(space.ids)):
        own = np.unique(space.features_of(h[at[i]: at[i + 1]]))
        chosen[own[np.argsort(seen[own], kind="stable")[:OWN_WORDS]]] = True
    space.keep(chosen)
    d = space.size
    space.idf = np.log((total + 1) / (seen[chosen] + 1)) + 1e-3
    rank = max(RANK, min(d // TERMS_A_RANK, CELLS // d))
    width = min(rank + EXTRA, d)
    omega = np.random.default_rng(seed).standard_normal((d, width))
    fitted, seeds = sc.broadcast(space), sc.broadcast(omega.astype(np.float32))

    def ranged(batches):
        s, m = fitted.value, seeds.value
        out = np.zeros((d, width))
        for passage, feature, n in slices(batches, s):
            if not len(feature):
                continue
            p, f, tf = _entries(passage, feature)
            w = _weights(p, f, tf, s.idf, n).astype(np.float32)
            new = np.concatenate([[True], p[1:] != p[:-1]])
            y = np.add.reduceat(m[f] * w[:, None], np.flatnonzero(new))
            own = np.cumsum(new) - 1
            order = np.argsort(f, kind="stable")
            f = f[order]
            head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            out[f[head]] += np.add.reduceat(y[own[order]] * w[order][:, None], head)
        return out

    # one-pass randomised decomposition of A'A from its range sketch (Nystroem form, shifted to stay positive)
    y = _summed(texts, ranged, (d, width))
    shift = 1e-6 * max(np.linalg.norm(y), 1e-12)
    omega = omega.astype(np.float32).astype(np.float64)
    y += shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values[-1], 1e-30)
    u, size, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    space.search(u[:, size > 1e-6 * size[0]][:, :rank])
    return space


def _spaces(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str):
    """Broadcast spaces of the benchmark, BLOCK_ITEMS items or so each."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    blocks = -(-items.count() // BLOCK_ITEMS)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        space = latent_space(docs.select(text_col), [tuple(r) for r in part])
        if space is not None:
            yield docs.sparkSession.sparkContext.broadcast(space)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, lcs, item_words, answer): the benchmark items found in each document.

    lcs: the longest common subsequence in words; answer: whether the item's
    last words stand in the document as they are. Null or blank texts match
    nothing, on either side; repeated rows are found each; ids may be null. An
    empty benchmark or table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("lcs", pa.int64()), ("item_words", pa.int64()), ("answer", pa.bool_())])
    spaces = list(_spaces(docs, "text", benchmark, item_col, item_text))

    def run(batches):
        for x in batches:
            ids = x.column(0)
            for lo, off, raw in C.slices(x.column(1)):
                at, h = plain_words(off, raw)
                out = [(ids[lo + r].as_py(), s.value.ids[item], lcs, int(s.value.at[item + 1] - s.value.at[item]), told) for s in spaces
                       for r, item, lcs, told in s.value.found(at, h)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, item_id long, lcs long, item_words long, answer boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns as they are."""
    spaces = list(_spaces(docs, text_col, benchmark, item_col, item_text))
    place = docs.columns.index(text_col)

    def run(batches):
        for x in batches:
            gone = np.zeros(x.num_rows, bool)
            for lo, off, raw in C.slices(x.column(place)):
                at, h = plain_words(off, raw)
                for s in spaces:
                    for r, *_ in s.value.found(at, h):
                        gone[lo + r] = True
            yield x.filter(pa.array(~gone))
        C.release()

    return docs.mapInArrow(run, docs.schema)
