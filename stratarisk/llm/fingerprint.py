"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed in runs of k; of every window of w consecutive runs the
smallest hash (by its leading 32 bits) is marked, the rightmost on ties. Two texts that share k + w - 1
consecutive words share a mark there: the choice depends on the window alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

GRAM, WINDOW = 5, 8
BLANKS = "\t\n\x0b\x0c\r"


def _let(value: Column, use) -> Column:
    """use(value) with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Runs without ASCII white space."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _merged(x: Column, step: int, join) -> Column:
    """join(x[i], x[i + step]) for every i that has both."""
    return F.zip_with(F.slice(x, 1, F.size(x) - step), F.slice(x, 1 + step, F.size(x)), join)


def _over(x: Column, width: int, join) -> Column:
    """A fold of each run of ``width`` elements, by doubling the runs."""
    def grow(have: int, runs: Column) -> Column:
        if have == width:
            return runs
        step = min(have, width - have)
        return _let(_merged(runs, step, join), lambda y: grow(have + step, y))
    return grow(1, x)


def gram_hashes(words: Column, k: int) -> Column:
    """A hash of each run of k words; fewer words make one run, none make none."""
    def of(x):
        return (F.when(F.size(x) >= k, _let(F.transform(x, lambda w: F.xxhash64(w)), lambda h: _over(h, k, lambda a, b: F.xxhash64(a, b))))
                .when(F.size(x) > 0, F.array(F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    return _let(words, of)


def _places(grams: Column, w: int) -> Column:
    """The marks, ascending: leading 32 bits of the smallest hash of each window, and below them how far its place is from the last possible one."""
    def of(g):
        placed = F.transform(g, lambda h, i: h.bitwiseAND(F.lit(-(1 << 32))).bitwiseOR((F.lit(0x7FFFFFFF) - i).cast("bigint")))
        return _let(placed, lambda v: F.when(F.size(v) >= w, F.array_distinct(_over(v, w, lambda a, b: F.least(a, b))))
                    .when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v))
    return _let(grams, of)


def winnow(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """struct(positions, hashes) of the marks of a text: word positions, and the 32 bits of the hashes that were compared."""
    return _let(_places(gram_hashes(words_of(F.coalesce(text, F.lit(""))), k), w), lambda v: F.struct(
        F.transform(v, lambda x: (F.lit(0x7FFFFFFF) - x.bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")).alias("positions"),
        F.transform(v, lambda x: F.shiftright(x, 32).cast("int")).alias("hashes")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two hash lists; two empty ones are alike."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y)).cast("double")
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.nullif(union, F.lit(0.0)))


def as_text(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda h: F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(doc_id, positions, hashes) for every row; a null or blank text has no marks. Other columns are ignored."""
    return docs.select(F.col(id_col).alias("doc_id"), winnow(F.col(text_col), k, w).alias("m")).select("doc_id", "m.positions", "m.hashes")


def _next_document(ids: DataFrame) -> DataFrame:
    """(d, t, next_d, next_t): the following key by descending id; the last is followed by the first.

    The keys are range-partitioned and numbered within their ranges; only the
    first key of each range meets the others.
    """
    order = [F.desc_nulls_last("d"), F.asc("t")]
    ranged = C.materialize(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "fingerprint-order")
    within = W.partitionBy("part").orderBy(*order)
    pair = F.struct("d", "t")
    led = ranged.select("d", "t", "part", F.lead(pair).over(within).alias("next"), F.row_number().over(within).alias("n"))
    firsts = led.where("n = 1").select("part", pair.alias("head"))
    over = W.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    return led.join(firsts, "part").select("d", "t", F.coalesce("next", "after").alias("next")).select("d", "t", F.col("next.d").alias("next_d"), F.col("next.t").alias("next_t"))


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Every row's fingerprint beside that of its edited text, and its likeness to both that and the next document.

    The edited text has its last third (floor of n_chars / 3 code points)
    replaced by the first as many of the next document by descending id. Rows
    alike in id and text count once in the order and each get a result; null
    ids come last. A null text is empty. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    ids = texts.groupBy("d", "t").agg(F.floor(F.first(F.char_length("text")) / 3).cast("int").alias("third"), F.count(F.lit(1)).alias("alike"))
    ids = C.materialize(ids, "fingerprint-ids")
    # rows alike in id and text would each answer as the next document
    single = texts.dropDuplicates(["d", "t"]) if ids.where("alike > 1").limit(1).count() else texts
    order = _next_document(ids.select("d", "t"))
    wanted = (order.join(ids.drop("alike").withColumnsRenamed({"d": "i", "t": "u"}), F.col("d").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")))
              .select(F.col("d").alias("own_d"), F.col("t").alias("own_t"), "next_d", "next_t", "third"))
    wanted = C.materialize(wanted, "fingerprint-next")
    heads = (single.join(wanted, F.col("d").eqNullSafe(F.col("next_d")) & (F.col("t") == F.col("next_t")))
             .select("own_d", "own_t", "third", F.substring("text", F.lit(1), F.col("third")).alias("head"), winnow(F.col("text"), k, w)["hashes"].alias("next_hashes")))
    both = texts.join(heads, F.col("d").eqNullSafe(F.col("own_d")) & (F.col("t") == F.col("own_t")))
    n = F.char_length("text")
    edited = both.select("d", n.cast("long").alias("n_chars"), winnow(F.col("text"), k, w)["hashes"].alias("own"), "next_hashes",
                         F.concat(F.substring("text", F.lit(1), n - F.col("third")), F.col("head")).alias("edited"))
    marked = edited.select("d", "n_chars", "own", "next_hashes", F.sha2("edited", 256).alias("edited_sha256"), winnow(F.col("edited"), k, w)["hashes"].alias("new"))
    return marked.select(F.col("d").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                         as_text(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"),
                         likeness(F.col("own"), F.col("next_hashes")).alias("near_next"))
