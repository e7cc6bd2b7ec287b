"""Cohort preparation: recode, cast, filter, band, impute, stratify, describe.

Every step is a narrow projection/filter in one lazy plan, so Catalyst
pushes the filters and column list to the Parquet scan. The only shuffles
are the final per-stratum aggregates, which combine map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.functions.scalar import band, recode, safe_double


def recode_outcomes(df: DataFrame, codes: dict[str, tuple[str, dict]]) -> DataFrame:
    """codes: outcome -> (raw code column, {code: label}). Unlisted -> null -> dropped."""
    out = df.withColumns({o: recode(src, m).cast("int") for o, (src, m) in codes.items()})
    return out.na.drop(subset=list(codes))


def cast_age(df: DataFrame, col: str = "age") -> DataFrame:
    return df.withColumn(col, safe_double(col))


def filter_min_age(df: DataFrame, col: str = "age", min_age: float = C.MIN_AGE) -> DataFrame:
    """``age >= min_age``; a null age fails the predicate and drops."""
    return df.where(F.col(col) >= F.lit(min_age))


def add_age_band(df: DataFrame, col: str = "age", out: str = "age_group",
                 uppers=None) -> DataFrame:
    return df.withColumn(out, band(col, uppers))


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast to double and replace every null (or unparsable value) with 0."""
    return df.withColumns({c: F.coalesce(safe_double(c), F.lit(0.0)) for c in cols})


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def prepare_cohort(raw: DataFrame, codes: dict[str, tuple[str, dict]], predictors: list[str],
                   keep: list[str], age_col: str = "age", min_age: float = C.MIN_AGE,
                   band_uppers=None) -> DataFrame:
    """Raw extract -> model-ready cohort (one lazy plan, no shuffle)."""
    df = recode_outcomes(raw, codes)
    df = cast_age(df, age_col)
    df = filter_min_age(df, age_col, min_age)
    df = add_age_band(df, age_col, "age_group", band_uppers)
    df = impute_zero(df, predictors)
    return df.select(*keep, age_col, "age_group", *codes.keys(), *predictors)


def assign_stratum(df: DataFrame, strata: DataFrame, sex_col: str = "sex",
                   band_col: str = "age_group") -> DataFrame:
    """Inner join with the strata dimension; rows in no stratum drop here.

    The dimension's size is fixed by configuration, so it is broadcast.
    """
    dim = strata.select(F.col("sex").alias("_sx"), F.col("age_group").alias("_ag"),
                        "stratum", "stratum_order")
    j = df.join(F.broadcast(dim), (F.col(sex_col) == F.col("_sx")) & (F.col(band_col) == F.col("_ag")))
    return j.drop("_sx", "_ag")


def _unpivot_outcomes(wide: DataFrame, keys: list[str], outcomes: list[str],
                      fields: list[str]) -> DataFrame:
    """Wide per-outcome columns ``{field}__{outcome}`` -> one row per outcome."""
    structs = [F.struct(F.lit(o).alias("outcome"),
                        *[F.col(f"{f}__{o}").alias(f) for f in fields]) for o in outcomes]
    return wide.select(*keys, F.explode(F.array(*structs)).alias("_o")).select(*keys, "_o.*")


def stratum_outcome_counts(cohort: DataFrame, strata: DataFrame, outcomes: list[str],
                           sex_col: str = "sex", band_col: str = "age_group") -> DataFrame:
    """(stratum, stratum_order, outcome, n, positives) for every configured stratum.

    Aggregates on the raw keys first (partial aggregation, tiny output), then
    joins the strata dimension so strata without rows stay with n = 0.
    """
    agg = (cohort.groupBy(F.col(sex_col).alias("sex"), F.col(band_col).alias("age_group"))
           .agg(F.count(F.lit(1)).alias("n"),
                *[F.sum(F.col(o).cast("bigint")).alias(f"positives__{o}") for o in outcomes]))
    dim = strata.select("stratum", "stratum_order", "sex", "age_group")
    # keep only configured strata (broadcast semi-join), so the aggregate is
    # bounded by the dimension and can be broadcast into the left join that
    # keeps empty strata
    agg = agg.join(F.broadcast(dim.select("sex", "age_group")), ["sex", "age_group"], "left_semi")
    j = dim.join(F.broadcast(agg), ["sex", "age_group"], "left")
    j = j.select("stratum", "stratum_order",
                 F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                 *[F.coalesce(f"positives__{o}", F.lit(0)).cast("bigint").alias(f"positives__{o}")
                   for o in outcomes])
    long = _unpivot_outcomes(j.withColumns({f"n__{o}": F.col("n") for o in outcomes}),
                             ["stratum", "stratum_order"], outcomes, ["n", "positives"])
    return long


def prevalence(cohort: DataFrame, strata: DataFrame, outcomes: list[str],
               small_sample: int = C.SMALL_SAMPLE_POSITIVES) -> DataFrame:
    """Stratum descriptive table: n, positives, prevalence % (1 dp), small-sample flag."""
    c = stratum_outcome_counts(cohort, strata, outcomes)
    pct = F.floor(F.lit(1000.0) * F.col("positives") / F.nullif(F.col("n"), F.lit(0)) + F.lit(0.5)) / F.lit(10.0)
    return c.select("stratum", "stratum_order", "outcome", "n", "positives",
                    pct.alias("prevalence_pct"),
                    (F.col("positives") < F.lit(small_sample)).alias("small_sample"))


def trainable_cells(cohort: DataFrame, strata: DataFrame, outcomes: list[str],
                    min_positives: int = C.MIN_POSITIVES_TRAIN) -> DataFrame:
    """Cell grid with the minimum-positives guard (cell kept, flag false)."""
    c = stratum_outcome_counts(cohort, strata, outcomes)
    return c.select("stratum", "outcome", "n", "positives",
                    (F.col("positives") >= F.lit(min_positives)).alias("trainable"))


def band_counts(cohort: DataFrame, band_col: str = "age_group") -> DataFrame:
    """Frequency count in key order."""
    return (cohort.groupBy(band_col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(band_col))


def class_weights(rows: DataFrame, cell_cols: list[str], label_col: str = "y") -> DataFrame:
    """Balanced class weight n / (2 * n_class) per cell and class (one groupBy)."""
    per_class = rows.groupBy(*cell_cols, label_col).agg(F.count(F.lit(1)).alias("n_class"))
    tot = per_class.groupBy(*cell_cols).agg(F.sum("n_class").alias("n_cell"))
    out = per_class.join(F.broadcast(tot), cell_cols)   # one row per cell
    return out.select(*cell_cols, F.col(label_col).alias("y"), "n_class",
                      (F.col("n_cell").cast("double") / (F.lit(2.0) * F.col("n_class"))).alias("weight"))


def weight_rows(rows: DataFrame, weights: DataFrame, cell_cols: list[str],
                label_col: str = "y", out: str = "weight") -> DataFrame:
    """Attach the per-class weight to each row (weights table: cells x 2 rows, broadcast)."""
    w = weights.select(*cell_cols, F.col("y").alias(label_col), F.col("weight").alias(out))
    return rows.join(F.broadcast(w), cell_cols + [label_col], "left")


def prevalence_by(df: DataFrame, stratum_col: str, outcomes: list[str],
                  small_sample: int = C.SMALL_SAMPLE_POSITIVES) -> DataFrame:
    """Prevalence for any stratum column (no strata dimension needed)."""
    agg = df.groupBy(stratum_col).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(o).cast("bigint")).alias(f"positives__{o}") for o in outcomes])
    long = _unpivot_outcomes(agg.withColumns({f"n__{o}": F.col("n") for o in outcomes}),
                             [stratum_col], outcomes, ["n", "positives"])
    pct = F.floor(F.lit(1000.0) * F.col("positives") / F.nullif(F.col("n"), F.lit(0)) + F.lit(0.5)) / F.lit(10.0)
    return long.select(stratum_col, "outcome", "n", "positives", pct.alias("prevalence_pct"),
                       (F.col("positives") < F.lit(small_sample)).alias("small_sample"))
