"""Reports over leaves, splits and experiment summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import cost_stratum


def leaf_strata(df: DataFrame, leaf: str, cost: str) -> DataFrame:
    """leaf, n, share of each cost stratum, the dominant one (ties: the lower), entropy (bits), mean, median and deviation of cost."""
    g = df.withColumn("s", cost_stratum(cost)).groupBy(leaf).agg(
        F.count("*").alias("n"), *(F.avg((F.col("s") == k).cast("double")).alias(f"share_{k}") for k in range(4)), F.avg(cost).alias("mean_cost"), F.percentile(cost, 0.5).alias("median_cost"), F.stddev_pop(cost).alias("std_cost")
    )
    shares = [F.col(f"share_{k}") for k in range(4)]
    top = F.greatest(*shares)
    dominant = F.coalesce(*(F.when(s == top, k) for k, s in enumerate(shares)))
    bits = sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in shares), F.lit(0.0))
    return g.withColumns({"dominant": dominant, "entropy": bits})


def selected_leaves(leaves: DataFrame, leaf: str, k: int, how: str = "largest") -> DataFrame:
    """The k largest leaves, or half of them largest and the rest of highest entropy ("diverse")."""
    if how == "largest":
        return leaves.orderBy(F.desc("n"), leaf).limit(k)
    big = leaves.orderBy(F.desc("n"), leaf).limit(k // 2)
    mixed = leaves.join(big.select(leaf), leaf, "left_anti").orderBy(F.desc("entropy"), leaf).limit(k - k // 2)
    return big.unionByName(mixed.select(*big.columns))


def summary(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """by, n and <measure>_mean, <measure>_std."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))


def best_rows(df: DataFrame, by: Sequence[str], measure: str, ties: Sequence[str]) -> DataFrame:
    """The whole row of the highest measure in each group, ties by the given columns."""
    rest = [c for c in df.columns if c not in by]
    rank = F.max(F.struct(F.col(measure).alias("__m"), *(F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)), F.struct(*rest).alias("row"))).alias("b")
    return df.where(F.col(measure).isNotNull()).groupBy(*by).agg(rank).select(*by, "b.row.*")


def ranked(df: DataFrame, measure: str, ties: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(measure), ties)))


def in_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows in a given order of one column's values, others after them."""
    place = F.coalesce(*(F.when(F.col(column) == v, i) for i, v in enumerate(order)), F.lit(len(order)))
    return df.orderBy(place, column)


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(*key), list(key), "left_anti").select(*new.columns).unionByName(new)


def split_difference(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Splits of two trees by path: both sides' columns with suffixes, and in which of them they are."""
    names = lambda df, s: df.select(F.col(key), *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != key), F.lit(1).alias(f"in_{s}"))
    return names(a, "a").join(names(b, "b"), key, "full").na.fill(0, ["in_a", "in_b"])


def split_usage(splits: DataFrame) -> DataFrame:
    return splits.groupBy("feature").agg(F.count("*").alias("n_splits"))


def difference_by(df: DataFrame, by: str, method: str, a: str, b: str, measure: str) -> DataFrame:
    """by, mean of either method, and their difference (null where one is missing)."""
    mean = lambda v: F.avg(F.when(F.col(method) == v, F.col(measure)))
    return df.groupBy(by).agg(mean(a).alias("mean_a"), mean(b).alias("mean_b")).withColumn("difference", F.col("mean_a") - F.col("mean_b"))


def closeness(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """n_a, n_b, n_both and n_far: rows of two tables and how many differ beyond the tolerance."""
    other = b.select(F.col(key), *(F.col(c).alias(f"{c}__b") for c in columns), F.lit(1).alias("in_b"))
    both = a.select(key, *columns, F.lit(1).alias("in_a")).join(other, key, "full")
    far: Column = F.lit(False)
    for c in columns:
        far = far | F.coalesce(F.abs(F.col(c) - F.col(f"{c}__b")) > atol + rtol * F.abs(F.col(f"{c}__b")), F.col(c).isNull() != F.col(f"{c}__b").isNull())
    met = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return both.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(met).alias("n_both"), F.count_if(met & far).alias("n_far"))


def jaccard_of_tops(a: Sequence[str], b: Sequence[str]) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0
