"""Deterministic per-group ranks: stratified split, k folds, n-per-group samples.

A plain ``row_number()`` over (cell, label) would put a whole stratum-class
on one task. Instead the rank is computed in two phases:

1. every row gets ``h = md5(id:tag:seed)[:8]`` and a bucket = the top
   ``bucket_bits`` bits of ``h``; rows are counted per (group, bucket) with
   map-side partial aggregation (output <= groups x 2^bits rows);
2. a prefix sum over that small count table gives each bucket's offset;
   rows are then ranked only inside their (group, bucket) and the offset is
   added back.

Ordering by (bucket, h, id) equals ordering by (h, id), so the result is the
exact global rank; it does not depend on partitioning, and the largest sort
is one bucket (1 / 2^bits of a group), which spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.functions.hashing import hash32

# Tables with at most this many rows (known from the configuration, not
# from data) are broadcast explicitly; larger ones are left to AQE, which
# only converts a join to broadcast after measuring the materialised side.
BROADCAST_ROW_BOUND = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int | None) -> DataFrame:
    return F.broadcast(df) if max_rows is not None and max_rows <= BROADCAST_ROW_BOUND else df


def hash_rank(df: DataFrame, group_cols: list[str], id_col: str, tag: str,
              seed: int = C.SEED, bucket_bits: int = 12, out: str = "rank",
              size_out: str | None = "group_n", max_groups: int | None = None) -> DataFrame:
    """Add the exact 1-based rank of each row within its group by (h, id).

    ``max_groups`` is a configuration-derived bound on distinct groups; with
    it the offset table (max_groups x 2^bits rows) is broadcast.
    """
    shift = 32 - bucket_bits
    # The count branch combines map-side (its shuffle carries at most
    # groups x 2^bits rows); only the ranking branch moves every row.
    d = (df.withColumn("_h", hash32(F.col(id_col), tag, seed))
           .withColumn("_b", F.shiftright(F.col("_h"), shift)))
    counts = d.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wg = Window.partitionBy(*group_cols)
    offsets = counts.select(
        *group_cols, "_b",
        (F.sum("_cnt").over(wg.orderBy("_b")) - F.col("_cnt")).alias("_off"),
        F.sum("_cnt").over(wg).alias("_gn"))
    bound = None if max_groups is None else max_groups * (1 << bucket_bits)
    local = F.row_number().over(Window.partitionBy(*group_cols, "_b").orderBy("_h", id_col))
    d = d.withColumn("_local", local)
    j = d.join(bounded_broadcast(offsets, bound), group_cols + ["_b"])
    j = j.withColumn("_rank_out", (F.col("_off") + F.col("_local")).cast("bigint"))
    if size_out:
        j = j.withColumn("_size_out", F.col("_gn").cast("bigint"))
    j = j.drop("_h", "_b", "_local", "_off", "_gn", "_cnt").withColumnRenamed("_rank_out", out)
    return j.withColumnRenamed("_size_out", size_out) if size_out else j


def stratified_split(df: DataFrame, cell_cols: list[str], label_col: str, id_col: str,
                     test_fraction: float = C.TEST_FRACTION, seed: int = C.SEED,
                     out: str = "is_test", max_groups: int | None = None,
                     bucket_bits: int = 12) -> DataFrame:
    """Label-stratified hold-out: per (cell, label) the first round(f * n) rows in
    (h, id) order are test, without shuffling the rows.

    1. bucket counts per (group, bucket) (map-side combined) give each group's
       target t = round(f * n) and the bucket holding the t-th row;
    2. only that bucket's rows are ranked, to find the t-th row's (h, id);
    3. every row is flagged by comparing its (bucket, h, id) with its group's
       threshold, a map against a broadcast table of one row per group.
    """
    groups = cell_cols + [label_col]
    shift = 32 - bucket_bits
    d = (df.withColumn("_h", hash32(F.col(id_col), "split", seed))
           .withColumn("_b", F.shiftright(F.col("_h"), shift)))
    counts = d.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wg = Window.partitionBy(*groups)
    off = counts.select(*groups, "_b", "_cnt",
                        (F.sum("_cnt").over(wg.orderBy("_b")) - F.col("_cnt")).alias("_off"),
                        F.sum("_cnt").over(wg).alias("_gn"))
    t = F.floor(F.lit(float(test_fraction)) * F.col("_gn") + F.lit(0.5))
    cut = (off.withColumn("_t", t)
              .where((F.col("_off") < F.col("_t")) & (F.col("_t") <= F.col("_off") + F.col("_cnt")))
              .select(*groups, F.col("_b").alias("_cb"), (F.col("_t") - F.col("_off")).alias("_r")))
    bound = None if max_groups is None else max_groups
    ren = {g: f"_k{i}" for i, g in enumerate(groups)}
    cut_r = cut.select(*[F.col(g).alias(ren[g]) for g in groups], "_cb", "_r")
    cond = [F.col(g) == F.col(ren[g]) for g in groups] + [F.col("_b") == F.col("_cb")]
    cand = d.join(bounded_broadcast(cut_r, bound), cond).select(*groups, "_cb", "_r", "_h", id_col)
    rn = F.row_number().over(Window.partitionBy(*groups).orderBy("_h", id_col))
    thr = (cand.withColumn("_rn", rn).where(F.col("_rn") == F.col("_r"))
               .select(*groups, "_cb", F.col("_h").alias("_th"), F.col(id_col).alias("_tid")))
    thr_r = thr.select(*[F.col(g).alias(ren[g]) for g in groups], "_cb", "_th", "_tid")
    j = d.join(bounded_broadcast(thr_r, bound), [F.col(g).eqNullSafe(F.col(ren[g])) for g in groups], "left")
    j = j.drop(*ren.values())
    below = (F.col("_b") < F.col("_cb")) | (
        (F.col("_b") == F.col("_cb")) &
        ((F.col("_h") < F.col("_th")) | ((F.col("_h") == F.col("_th")) & (F.col(id_col) <= F.col("_tid")))))
    # groups with target 0 have no threshold row: nothing is test
    return j.withColumn(out, F.coalesce(below, F.lit(False))).drop("_h", "_b", "_cb", "_th", "_tid")


def stratified_folds(df: DataFrame, cell_cols: list[str], label_col: str, id_col: str,
                     k: int = C.N_FOLDS, seed: int = C.SEED, out: str = "fold",
                     max_groups: int | None = None, bucket_bits: int = 12) -> DataFrame:
    """Label-stratified k folds: fold = (rank - 1) mod k within (cell, label)."""
    r = hash_rank(df, cell_cols + [label_col], id_col, "fold", seed, bucket_bits,
                  "_rk", None, max_groups)
    return r.withColumn(out, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def hash_top_k(df: DataFrame, group_cols: list[str], id_col: str, k: int, tag: str,
               seed: int = C.SEED, bucket_bits: int = 16, out: str = "_rank",
               salt_col: str | None = None, max_groups: int | None = None) -> DataFrame:
    """The k rows with the smallest (h, id) per group, with their exact rank.

    Only buckets whose offset is below k can hold a top-k row, so after the
    (partial-aggregated) bucket count every other row is discarded before
    anything is shuffled; ranking then runs on about k + n / 2^bits rows per
    group, split by bucket.
    """
    parts = [F.col(id_col), tag, seed] + ([F.col(salt_col)] if salt_col else [])
    d = (df.withColumn("_h", hash32(*parts))
           .withColumn("_b", F.shiftright(F.col("_h"), 32 - bucket_bits)))
    counts = d.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    off = counts.select(*group_cols, "_b",
                        (F.sum("_cnt").over(Window.partitionBy(*group_cols).orderBy("_b"))
                         - F.col("_cnt")).alias("_off"))
    keep = off.where(F.col("_off") < F.lit(k))
    bound = None if max_groups is None else max_groups * (1 << bucket_bits)
    cand = d.join(bounded_broadcast(keep, bound), group_cols + ["_b"])
    local = F.row_number().over(Window.partitionBy(*group_cols, "_b").orderBy("_h", id_col))
    r = cand.withColumn("_rk_out", (F.col("_off") + local).cast("bigint"))
    r = r.where(F.col("_rk_out") <= F.lit(k)).drop("_h", "_b", "_off")
    return r.withColumnRenamed("_rk_out", out)


def sample_n_per_group(df: DataFrame, group_cols: list[str], id_col: str, n: int,
                       seed: int = C.SEED, tag: str = "sample", out: str = "sample_rank",
                       max_groups: int | None = None, bucket_bits: int = 16) -> DataFrame:
    """Seeded sample without replacement: at most n rows per group (the rank is kept)."""
    return hash_top_k(df, group_cols, id_col, n, tag, seed, bucket_bits, out,
                      max_groups=max_groups)


def split_and_folds(df: DataFrame, cell_cols: list[str], label_col: str, id_col: str,
                    test_fraction: float = C.TEST_FRACTION, k: int = C.N_FOLDS,
                    seed: int = C.SEED, max_groups: int | None = None,
                    bucket_bits: int = 12) -> DataFrame:
    """Hold-out flag and k-fold id from one shared rank (one round of shuffles)."""
    r = hash_rank(df, cell_cols + [label_col], id_col, "split", seed, bucket_bits,
                  "_rk", "_gn", max_groups)
    n_test = F.floor(F.lit(float(test_fraction)) * F.col("_gn") + F.lit(0.5))
    return (r.withColumn("is_test", F.col("_rk") <= n_test)
             .withColumn("fold", ((F.col("_rk") - 1) % k).cast("int"))
             .drop("_rk", "_gn"))
