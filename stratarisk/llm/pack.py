"""Packing: token sequences of at most ``capacity`` ids, by multiway differencing.

A document's ids are cut into whole sequences and a rest; the rest is cut into
pieces. A task gathers ``group`` pieces at a time and partitions them into
windows by Karmarkar-Karp multiway differencing: the two partial partitions
with the largest imbalance are merged, the fullest bins of one with the
emptiest of the other, until one partition is left. If a bin exceeds the
capacity, the number of windows rises and the group is partitioned again.
Groups lie within one input partition, so nothing is shuffled and a lost task
is redone by itself.
"""

from __future__ import annotations

import heapq
import os
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY, PIECE, GROUP = 2048, 512, 1024
#: remembered words per worker (some 200 bytes each); beyond it the memory is emptied and starts anew
REMEMBERED = 500_000
#: bins of a partial partition up to which plain lists are faster than arrays
FEW = 32
MARKS = ".,;:!?"
#: fixed value: the word pattern of the byte-level vocabulary
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: the items of each of ``windows`` bins.

    A partial partition has its bins by falling size: a list of (-size, bin), from ``FEW`` bins on two arrays.
    """
    heap, join = [(-v, i, [(-v, i)]) for i, v in enumerate(sizes.tolist())], {}
    heapq.heapify(heap)
    node = len(sizes)
    turn = len(sizes)
    by_size = itemgetter(0)

    def arrays(part):
        return part if isinstance(part, tuple) else (np.array([-v for v, _ in part], np.int64), np.array([i for _, i in part], np.int64))

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if isinstance(a, list) and isinstance(b, list) and len(a) + len(b) <= min(FEW, windows):
            part = a + b
            part.sort(key=by_size)
            spread = -part[0][0] - (-part[-1][0] if len(part) == windows else 0)
            heapq.heappush(heap, (-spread, turn, part))
            turn += 1
            continue
        (a, at_a), (b, at_b) = arrays(a), arrays(b)
        over = len(a) + len(b) - windows
        if over <= 0:
            s, at = np.concatenate([a, b]), np.concatenate([at_a, at_b])
        else:
            # a's emptiest non-empty bins meet b's: largest with smallest; the others meet empty bins
            x, y = a[len(a) - over:], b[len(b) - over:][::-1]
            fresh = np.arange(node, node + over)
            for k, (p, q) in enumerate(zip(at_a[len(a) - over:].tolist(), at_b[len(b) - over:][::-1].tolist())):
                join[node + k] = (p, q)
            node += over
            s = np.concatenate([a[: len(a) - over], b[: len(b) - over], x + y])
            at = np.concatenate([at_a[: len(a) - over], at_b[: len(b) - over], fresh])
        order = np.argsort(-s, kind="stable")
        s, at = s[order], at[order]
        spread = int(s[0]) - (int(s[-1]) if len(s) == windows else 0)
        heapq.heappush(heap, (-spread, turn, (s, at)))
        turn += 1
    out = []
    for root in (arrays(heap[0][2])[1].tolist() if heap else []):
        items, todo = [], [root]
        while todo:
            n = todo.pop()
            if n in join:
                todo.extend(join[n])
            else:
                items.append(n)
        out.append(sorted(items))
    return out


def windows_of(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins within the capacity: as few as the differencing reaches; the count rises whenever one is exceeded."""
    total = int(sizes.sum())
    n = max(1, -(-total // capacity))
    while True:
        bins = differencing(sizes, n)
        most = max((int(sizes[b].sum()) for b in bins), default=0)
        if most <= capacity:
            return bins
        n = max(n + 1, -(-total // max(1, capacity - (most - total // n))) if most - total // n < capacity // 4 else n + 1)


class Encoder:
    """Ids of texts by a byte-level BPE file, remembering words.

    A byte-level BPE encodes each match of its word pattern by itself, so a
    text's ids are those of its matches. Texts are cut at spaces first: a
    space-led chunk is matched the same alone as within the text, unless the
    space stands between two white spaces; then the chunk before it ends in
    white space, and the text is matched whole. Matches not met before are
    encoded by the tokenizer, many at a time. The file's added tokens are seen
    before the word pattern and may reach over several matches: a text that
    contains one goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.match = regex.compile(WORD_PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.mids: dict[str, bytes] = {}
        self.marks = dict(zip(MARKS, self._ids(list(MARKS))))
        vocabulary = self.t.get_vocab()
        #: whether an id stands for bytes that begin with a space
        self.led = np.zeros(max(vocabulary.values()) + 1, bool)
        self.led[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _has_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def _ids_of_led(self, words: list[str]) -> dict[str, bytes]:
        """Ids of " " + word for words of letters: many in one text, each beginning at the one id that begins with a space."""
        out: dict[str, bytes] = {}
        for i in range(0, len(words), 1000):
            some = words[i: i + 1000]
            joined = " " + " ".join(some)
            if self._has_added(joined):
                out.update(zip(some, self._ids([" " + w for w in some])))
                continue
            ids = np.asarray(self.t.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cut = np.append(np.flatnonzero(self.led[ids]), len(ids))
            if len(cut) == len(some) + 1:
                raw, ends = ids.tobytes(), (4 * cut).tolist()
                out.update(zip(some, [raw[x:y] for x, y in zip(ends, ends[1:])]))
            else:
                out.update(zip(some, self._ids([" " + w for w in some])))
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.t.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: list[str]) -> None:
        self.words.update(zip(new, self._ids(new)))

    def _remember_led(self, keys: set[str]) -> None:
        """Ids of the space-led chunks: words of letters, such words with one mark behind, and all others by the pattern."""
        mids, plain, marked, others = self.mids, set(), [], []
        for k in keys:
            if k.isalpha():
                plain.add(k)
            elif k[:-1].isalpha() and k[-1] in MARKS:
                marked.append(k)
                if k[:-1] not in mids:
                    plain.add(k[:-1])
            else:
                others.append(k)
        mids.update(self._ids_of_led(list(plain)))
        for k in marked:
            mids[k] = mids[k[:-1]] + self.marks[k[-1]]
        self._remember(mids, others, " ")

    def _remember(self, memory: dict, keys: list[str], lead: str) -> None:
        matched = [self.match(lead + k) for k in keys]
        self._learn([w for w in {w for m in matched for w in m} if w not in self.words])
        get = self.words.__getitem__
        for k, m in zip(keys, matched):
            memory[k] = False if (k[-1:] or lead).isspace() else b"".join(map(get, m))

    def _whole(self, text: str) -> bytes:
        m = self.match(text)
        self._learn([w for w in set(m) if w not in self.words])
        return b"".join(map(self.words.__getitem__, m))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self._has_added(t)]
        if not whole:
            return self._by_words(texts)
        out = dict(zip(whole, self._ids([texts[i] for i in whole])))
        rest = [i for i in range(len(texts)) if i not in out]
        out.update(zip(rest, self._by_words([texts[i] for i in rest])))
        return [out[i] for i in range(len(texts))]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        for memory in (self.words, self.heads, self.mids):
            if len(memory) > REMEMBERED:
                memory.clear()
        parts = [t.split(" ") for t in texts]
        first = [p.pop(0) for p in parts]
        self._remember(self.heads, list({f for f in first if f and f not in self.heads}), "")
        self._remember_led(set().union(*parts) - self.mids.keys())
        out = []
        head, mid = self.heads.__getitem__, self.mids.__getitem__
        for t, f, p in zip(texts, first, parts):
            try:
                out.append((head(f) if f else b"") + b"".join(map(mid, p)))
            except TypeError:
                out.append(self._whole(t))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   piece: int = PIECE, end_id: int = 1, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids (little-endian uint32).

    tokenizer: path of a ``tokenizers`` file that every executor can read. A
    null or empty text is the end id alone. Every row is packed, whatever its
    id (null and repeated ids too); other columns are ignored. sequence_id is
    the partition number and a count within it; offset has no gaps.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.binary())] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder, base, made = encoder(tokenizer), TaskContext.get().partitionId() << 33, 0
        out, held = [], []

        def placed(item, sequence, offset):
            doc, start, length, crc, total, ids = item
            out.append((doc, start, length, crc, total, sequence, offset, ids) if with_ids else (doc, start, length, crc, total, sequence, offset))

        def pack(items):
            nonlocal made
            for b in windows_of(np.array([x[2] for x in items], np.int64), capacity):
                at = 0
                for i in b:
                    placed(items[i], base + made, at)
                    at += items[i][2]
                made += 1

        def rows():
            got = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, schema)], schema=schema)

        for x in batches:
            ids, col = x.column(0).to_pylist(), x.column(1)
            for lo, off, _ in C.slices(col):
                for k, raw in enumerate(coder.encode(col.slice(lo, len(off) - 1).to_pylist())):
                    raw += end
                    n, at = len(raw) // 4, 0
                    while at < n:
                        size = capacity if n - at >= capacity else min(piece, n - at)
                        part = raw[4 * at: 4 * (at + size)]
                        item = (ids[lo + k], at, size, zlib.crc32(part), n, part if with_ids else None)
                        if size == capacity:
                            placed(item, base + made, 0)
                            made += 1
                        else:
                            held.append(item)
                        at += size
                while len(held) >= group:
                    pack(held[:group])
                    del held[:group]
                if len(out) >= 10_000:
                    yield rows()
        if held:
            pack(held)
        if out:
            yield rows()
        C.release()

    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
