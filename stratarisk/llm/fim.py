"""Fill-in-middle transformation as one pyarrow.compute pipeline per batch.

Texts are cut into units (code points) held as list arrays over the text's own
bytes; the lists are flattened with their parent indices, every unit gets its
ordinal within its document, units are filtered by role (prefix, middle,
suffix), lists are rebuilt per role and joined to pieces, and the pieces are
joined with the markers. Long texts pass through in segments of bounded size,
whose pieces are joined once more, so that a text of any length needs little
beyond its own bytes.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: bytes of a segment, and of the segments that are cut into units at once
SEGMENT_BYTES, GROUP_BYTES = 1 << 18, 1 << 20
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def _units(texts: pa.Array) -> pa.ListArray:
    """Each text as the list of its code points: strings over the bytes of the array itself."""
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    off = pa.Array.from_buffers(pa.int64(), len(texts) + 1, [None, off], offset=texts.offset)
    lo, hi = off[0].as_py(), off[-1].as_py()
    b = pa.Array.from_buffers(pa.uint8(), hi - lo, [None, data], offset=lo) if hi > lo else pa.array([], pa.uint8())
    leads = pc.not_equal(pc.bit_wise_and(b, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8()))
    at = pc.add(pc.indices_nonzero(leads).cast(pa.int64()), lo)
    ends = pa.concat_arrays([at, pa.array([hi], pa.int64())])
    units = pa.Array.from_buffers(pa.large_string(), len(at), [None, ends.buffers()[1], data if data is not None else pa.py_buffer(b"")])
    lengths = pc.utf8_length(texts).cast(pa.int64())
    return pa.LargeListArray.from_arrays(_bounds(lengths), units)


def _bounds(lengths: pa.Array) -> pa.Array:
    """Offsets of lists with these lengths."""
    return pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(lengths)]) if len(lengths) else pa.array([0], pa.int64())


def _joined(values: pa.Array, parents: pa.Array, n: int) -> pa.Array:
    """Values joined per parent (ascending) to n strings; a parent without values gives an empty one."""
    ends = pc.value_counts(parents)
    count = pa.repeat(pa.scalar(0, pa.int64()), n)
    if len(ends):
        has = pc.is_in(_count(n), value_set=ends.field(0))
        count = pc.replace_with_mask(count, has, ends.field(1))
    return pc.binary_join(pa.LargeListArray.from_arrays(_bounds(count), values), pa.scalar("", pa.large_string()))


def _pieces(texts: pa.Array, first: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each segment: its units before ordinal ``low``, those before ``high``, and the others. first: ordinal of its first unit."""
    lists = _units(texts)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    start = pc.subtract(first, lists.offsets.slice(0, len(texts)))
    ordinal = pc.add(_count(len(units)), start.take(parent))
    before_low, before_high = pc.less(ordinal, low.take(parent)), pc.less(ordinal, high.take(parent))
    roles = (before_low, pc.and_not(before_high, before_low), pc.invert(before_high))
    return [_joined(units.filter(role), parent.filter(role), len(texts)) for role in roles]


def _count(n: int) -> pa.Array:
    """0 .. n - 1."""
    return pc.subtract(pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), n)), 1) if n else pa.array([], pa.int64())


def _segments(texts: pa.Array) -> tuple[list[pa.Array], list[int]]:
    """Each text whole, or cut at code points into segments of at most SEGMENT_BYTES; and the text that each segment belongs to."""
    size = pc.binary_length(texts)
    if not pc.any(pc.greater(size, SEGMENT_BYTES)).as_py():
        return [texts], list(range(len(texts)))
    parts, owner = [], []
    for i, bytes_ in enumerate(size.to_pylist()):
        if bytes_ <= SEGMENT_BYTES:
            parts.append(texts.slice(i, 1))
            owner.append(i)
            continue
        raw, at = texts[i].as_buffer(), 0
        while at < bytes_:
            end = min(at + SEGMENT_BYTES, bytes_)
            while end < bytes_ and raw[end] & 0xC0 == 0x80:
                end -= 1
            parts.append(pa.Array.from_buffers(pa.large_string(), 1, [None, pa.array([at, end], pa.int64()).buffers()[1], raw]))
            owner.append(i)
            at = end
    return parts, owner


def split_roles(texts: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of every text, cut before the units ``low`` and ``high``."""
    texts = texts.cast(pa.large_string())
    parts, owner = _segments(texts)
    parts = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
    owners = pa.array(owner, pa.int64())
    units = pc.utf8_length(parts).cast(pa.int64())
    run = _bounds(units).slice(0, len(parts))
    firsts = run.take(pc.index_in(owners, value_set=owners)) if len(owners) else run
    first = pc.subtract(run, firsts)
    low, high = low.take(owners), high.take(owners)
    size, made, lo = pc.binary_length(parts).to_pylist(), [], 0
    while lo < len(parts):
        hi, held = lo + 1, size[lo]
        while hi < len(parts) and held + size[hi] <= GROUP_BYTES:
            held += size[hi]
            hi += 1
        made.append(_pieces(*(x.slice(lo, hi - lo) for x in (parts, first, low, high))))
        lo = hi
    out = [pa.concat_arrays([m[k] for m in made]) if made else pa.array([], pa.large_string()) for k in range(3)]
    return out if len(parts) == len(texts) else [_joined(x, owners, len(texts)) for x in out]


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


def transform(batches):
    """Batches of (id, text, n, form, low, high) to batches of (id, n, form, prefix_chars, middle_chars, output)."""
    nothing = _text("")
    for x in batches:
        text, n, form, low, high = (x.column(k) for k in range(1, 6))
        text, plain = text.cast(pa.large_string()), pc.equal(form, "plain")
        prefix, middle, suffix = split_roles(pc.if_else(plain, nothing, text), low, high)
        psm = pc.binary_join_element_wise(_text(PREFIX), prefix, _text(SUFFIX), suffix, _text(MIDDLE), middle, nothing)
        spm = pc.binary_join_element_wise(_text(SUFFIX), suffix, _text(PREFIX), prefix, _text(MIDDLE), middle, nothing)
        output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "spm"), spm, psm))
        lengths = [pc.if_else(plain, pa.scalar(None, pa.int64()), y) for y in (low, pc.subtract(high, low))]
        yield pa.RecordBatch.from_arrays([x.column(0), n, form, *lengths, output], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1",
                   fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    n counts code points. Where the text is cut and its form follow from the
    first four 8-digit groups of the hex SHA-256 of ``seed:id``, so that reruns
    agree. Form ``plain`` (output: the text) has an empty or null text, one
    that holds a marker, and the share of ids beyond ``fim_percent``; of the
    others ``spm_percent`` are suffix first, the rest prefix first. A null id
    counts as an empty string. Rows alike in id and text give equal rows; other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    n = F.char_length(text).cast("long")
    cut = docs.select(F.col(id_col).alias("id"), text.alias("text"), n.alias("n"), *[x.alias(f"h{k}") for k, x in enumerate(h)])
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = (F.when((F.col("n") == 0) | marked | (F.col("h2") % 100 >= fim_percent), "plain")
            .when(F.col("h3") % 100 < spm_percent, "spm").otherwise("psm"))
    one, two = F.col("h0") % (F.col("n") + 1), F.col("h1") % (F.col("n") + 1)
    cut = cut.select("id", "text", "n", form.alias("form"), F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    kind = cut.schema["id"].dataType.simpleString()
    return cut.mapInArrow(transform, f"id {kind}, {MADE}").withColumnRenamed("id", id_col)


def _after(x: pa.Array) -> pa.Array:
    """Without the marker at the front."""
    return pc.utf8_slice_codeunits(x, len(PREFIX))


def _halves(x: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first ``marker``."""
    both = pc.split_pattern(x, marker, max_splits=1)
    return pc.list_element(both, 0), pc.list_element(both, 1)


def restore_texts(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts again, from the outputs and their forms alone: markers occur nowhere else in a transformed text."""
    out = output.cast(pa.large_string())
    whole = out
    for kind, second in (("psm", SUFFIX), ("spm", PREFIX)):
        at = pc.equal(form, kind)
        own = out.filter(at)
        if not len(own):
            continue
        first, rest = _halves(_after(own), second)
        rest, middle = _halves(rest, MIDDLE)
        prefix, suffix = (first, rest) if kind == "psm" else (rest, first)
        whole = pc.replace_with_mask(whole, at, pc.binary_join_element_wise(prefix, middle, suffix, _text("")))
    return whole


def restore(made: DataFrame, form_col: str = "form", output_col: str = "output", out: str = "restored") -> DataFrame:
    """``made`` with the texts rebuilt from output and form as a further column."""
    names = made.columns

    def run(batches):
        for x in batches:
            text = restore_texts(x.column(names.index(output_col)), x.column(names.index(form_col)))
            yield pa.RecordBatch.from_arrays([*x.columns, text], names=[*names, out])

    return made.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema) + f", {out} string")
