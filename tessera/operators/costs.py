"""Quarterly costs, their changes, moments and patterns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.claims import deflated, in_years

QUARTERS = (1, 2, 3, 4)


def quarterly(claims: DataFrame, year: int, measures: dict[str, Column], key="enrolid", date="svcdate", fill: bool = True) -> DataFrame:
    """One row an id with <year>Q<n>_<measure> columns: conditional sums in a single aggregate, no pivot job."""
    rows = claims.where(in_years(date, [year])).select(key, F.quarter(date).alias("__q"), *(m.alias(n) for n, m in measures.items()))
    cells = [F.sum(F.when(F.col("__q") == q, F.col(n))).alias(f"{year}Q{q}_{n}") for q in QUARTERS for n in measures]
    out = rows.groupBy(key).agg(*cells)
    return out.na.fill(0) if fill else out


def typed_costs(cost: str, has_condition: Column, has_comorbid: Column, has_procedure: Column, factors: dict[int, float], year: Column) -> dict[str, Column]:
    """Cost measures of a claim: condition, procedure, comorbidity alone, and the claim itself.

    The flags keep SQL's three-valued logic: where has_condition is NULL a comorbidity claim counts 0.
    """
    c = deflated(cost, year, factors)
    pick = lambda test: F.when(test, c).otherwise(0.0)
    return {
        "condition_cost": pick(has_condition),
        "procedure_cost": pick(has_procedure),
        "comorbidity_only_cost": pick(has_comorbid & ~has_condition),
        "total_claims": F.lit(1),
    }


def _cells(year: int, measure: str) -> list[Column]:
    return [F.coalesce(F.col(f"{year}Q{q}_{measure}").cast("double"), F.lit(0.0)) for q in QUARTERS]


def annual_sums(df: DataFrame, year: int, measures: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{m}_{year}": reduce(lambda a, b: a + b, _cells(year, m)) for m in measures})


def derivatives(year: int, measure: str) -> dict[str, Column]:
    """Changes between quarters, whether each is a rise, how many are; 0 rises count as consistently decreasing, flat or not."""
    q = _cells(year, measure)
    steps = [(b - a, f"Q{i + 1}_Q{i + 2}") for i, (a, b) in enumerate(zip(q, q[1:], strict=False))]
    rises = reduce(lambda a, b: a + b, [F.when(d > 0, 1).otherwise(0) for d, _ in steps])
    out = {f"{measure}_deriv_{n}_{year}": d for d, n in steps}
    out |= {f"{measure}_is_increasing_{n}_{year}": F.when(d > 0, 1).otherwise(0) for d, n in steps}
    out[f"{measure}_total_increasing_{year}"] = rises
    out[f"{measure}_consistently_increasing_{year}"] = F.when(rises == 3, 1).otherwise(0)
    out[f"{measure}_consistently_decreasing_{year}"] = F.when(rises == 0, 1).otherwise(0)
    out[f"{measure}_mean_deriv_{year}"] = reduce(lambda a, b: a + b, [d for d, _ in steps]) / 3
    return out


def moments(df: DataFrame, year: int, measure: str, keep_spread: bool = False) -> DataFrame:
    """Population skewness and excess kurtosis, cv, max, min and range over the four quarters, and pattern buckets.

    Mean and deviation are columns of their own projection, so each is computed once.
    """
    q = _cells(year, measure)
    pre = f"{measure}_quarterly"
    mean, std = F.col(f"{pre}_mean_{year}"), F.col(f"{pre}_std_{year}")
    df = df.withColumn(f"{pre}_mean_{year}", reduce(lambda a, b: a + b, q) / 4)
    df = df.withColumn(f"{pre}_std_{year}", F.sqrt(reduce(lambda a, b: a + b, [(x - mean) * (x - mean) for x in q]) / 4))
    z = [F.try_divide(x - mean, std) for x in q]
    power = lambda n: reduce(lambda a, b: a + b, [reduce(lambda u, v: u * v, [x] * n) for x in z]) / 4
    skew, cv = F.col(f"{pre}_skewness_{year}"), F.col(f"{pre}_cv_{year}")
    df = df.withColumns(
        {
            f"{pre}_skewness_{year}": F.when(std > 0, power(3)).otherwise(0.0),
            f"{pre}_kurtosis_{year}": F.when(std > 0, power(4) - 3).otherwise(0.0),
            f"{pre}_cv_{year}": F.when(mean > 0, F.try_divide(std, mean)).otherwise(0.0),
            f"{pre}_max_{year}": F.greatest(*q),
            f"{pre}_min_{year}": F.least(*q),
            f"{pre}_range_{year}": F.greatest(*q) - F.least(*q),
        }
    )
    df = df.withColumns(
        {
            f"{measure}_pattern_{year}": F.when(skew > 0.5, "late_heavy").when(skew < -0.5, "early_heavy").otherwise("balanced"),
            f"{measure}_stability_{year}": F.when(cv < 0.3, "stable").when(cv > 1.0, "highly_volatile").otherwise("moderate"),
        }
    )
    return df.drop(f"{pre}_mean_{year}") if keep_spread else df.drop(f"{pre}_mean_{year}", f"{pre}_std_{year}")


def wide_cost_features(df: DataFrame, year: int, measure: str) -> DataFrame:
    """Total, trend (last quarter less first) and volatility (root of the mean squared deviation)."""
    q = _cells(year, measure)
    total = reduce(lambda a, b: a + b, q)
    spread = reduce(lambda a, b: a + b, [(x - total / 4) * (x - total / 4) for x in q]) / 4
    return df.withColumns({f"{measure}_total_{year}": total, f"{measure}_trend_{year}": q[3] - q[0], f"{measure}_volatility_{year}": F.sqrt(spread)})


def pattern_report(df: DataFrame, year: int, measure: str, cost: str) -> DataFrame:
    """By pattern and stability: ids, mean cost, shares of consistent rises and falls."""
    share = lambda n: F.avg(F.col(f"{measure}_consistently_{n}_{year}"))
    return df.groupBy(F.col(f"{measure}_pattern_{year}").alias("pattern"), F.col(f"{measure}_stability_{year}").alias("stability")).agg(
        F.count("*").alias("n"), F.avg(cost).alias("mean_cost"), share("increasing").alias("share_increasing"), share("decreasing").alias("share_decreasing")
    )


def cost_histogram(df: DataFrame, cost: str, edges: Sequence[float]) -> DataFrame:
    """Counts in half-open ranges, the last one open: (low, n)."""
    low = None
    for e in reversed(edges):
        low = F.when(F.col(cost) >= e, float(e)) if low is None else low.when(F.col(cost) >= e, float(e))
    return df.select(low.alias("low")).where("low IS NOT NULL").groupBy("low").agg(F.count("*").alias("n"))
