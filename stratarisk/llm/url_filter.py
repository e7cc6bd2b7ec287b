"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the other URLs.

DataFrame functions and Spark ML only; nothing runs in Python workers.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: at most about this many labelled URLs are used to fit; chosen by a hash of the URL
FIT_ROWS = 20_000
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "query_length", "has_fragment", "secure",
            "hyphens", "extension", "suffix_rate", "suffix2_rate", "suffix_count"]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://"."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. rules: (host and path prefix like "example.net/en/", verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def suffix(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of column ``url`` (with ``host`` and ``path`` beside it)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    chars = F.split(url, "")
    entropy = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n), F.lit(0.0),
                          lambda a, p: a - p * F.log2(p))
    count = lambda c, what: F.char_length(c) - F.char_length(F.replace(c, F.lit(what), F.lit("")))
    made = {
        "length": F.char_length(url), "host_length": F.char_length("host"), "path_length": F.char_length("path"), "depth": count(F.col("path"), "/"),
        "labels": count(F.col("host"), ".") + 1, "digit_ratio": F.char_length(F.regexp_replace(url, "[^0-9]", "")) / n, "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_length": F.char_length(query), "has_fragment": F.contains(url, F.lit("#")),
        "secure": F.startswith(url, F.lit("https:")), "hyphens": count(url, "-"), "extension": F.rlike("path", F.lit("\\.[A-Za-z0-9]{1,5}$")),
    }
    return urls.withColumns({k: v.cast("double") for k, v in made.items()})


def _suffix_statistics(fit: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Smoothed block rate and count of the last one and two labels of the host, from the labelled URLs (at most FIT_ROWS or so rows each)."""
    rate = fit.agg(F.avg("label")).first()[0]
    one, two = (fit.groupBy(suffix(F.col("host"), n).alias(f"suffix{n}"))
                .agg(((F.sum("label") + F.lit(4.0 * rate)) / (F.count(F.lit(1)) + 4.0)).alias(f"rate{n}"), F.count(F.lit(1)).cast("double").alias(f"count{n}"))
                for n in (1, 2))
    return one, two, rate


def _with_suffixes(df: DataFrame, one: DataFrame, two: DataFrame, rate: float) -> DataFrame:
    keyed = df.withColumn("suffix1", suffix(F.col("host"), 1)).withColumn("suffix2", suffix(F.col("host"), 2))
    return (keyed.join(F.broadcast(one), "suffix1", "left").join(F.broadcast(two), "suffix2", "left")
            .withColumns({"suffix_rate": F.coalesce("rate1", F.lit(rate)), "suffix2_rate": F.coalesce("rate2", F.lit(rate)),
                          "suffix_count": F.log1p(F.coalesce("count2", F.lit(0.0)))}))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = 12, depth: int = 4):
    """A function that adds ``score`` (probability of block) to URLs, or None if the labelled URLs do not have both classes.

    labelled: url, host, path, label (1.0 block, 0.0 allow). Training uses the
    rows with the smallest hashes, about ``fit_rows`` of them.
    """
    classes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(classes.values())
    if len(classes) < 2:
        return None
    part = int(min(1.0, fit_rows / n) * (1 << 30))
    chosen = labelled.where(F.xxhash64("url", F.lit("fit")).bitwiseAND(F.lit((1 << 30) - 1)) < part)
    chosen = lexical(chosen).select("url", "host", "path", "label", *FEATURES[:13]).checkpoint()
    one, two, rate = _suffix_statistics(chosen)
    one, two = one.checkpoint(), two.checkpoint()
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=17, maxBins=64)
    model = trees.fit(assembler.transform(_with_suffixes(chosen, one, two, rate)).select("features", "label"))

    def score(urls: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        made = model.transform(assembler.transform(_with_suffixes(lexical(urls), one, two, rate)))
        return made.withColumn("score", vector_to_array("probability")[1])

    return score


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    The longest fitting rule decides; other URLs are blocked if the trees give
    0.5 or more. labelled: url, label (1.0 block, 0.0 allow); by default the
    URLs that the rules decide are the labelled ones. With only one class of
    labels there is nothing to learn and the other URLs are allowed. A null
    url has empty host and path, and is judged like any other that no rule
    fits. Rows may repeat; other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, says = rule_column(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "says": says})
    if labelled is None:
        known = urls.where("says is not null").select("url", "host", "path", (F.col("says") == "block").cast("double").alias("label"))
    else:
        known = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    score = fit(known.where("url is not null and label is not null"))
    scored = score(urls) if score else urls.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("says", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
