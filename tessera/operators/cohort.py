"""Cohorts, annual costs and outcome labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.claims import cost_stratum, cutoff_ladder, deflated, disease_stage, in_any, in_years, normalize_code


def members_only(df: DataFrame, ids: DataFrame, key: str = "enrolid") -> DataFrame:
    """Rows of the given ids."""
    return df.join(ids.select(key), key, "left_semi")


def without_members(df: DataFrame, ids: DataFrame, key: str = "enrolid") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def annual_costs(claims: DataFrame, factors: dict[int, float], where: Column | None = None, key="enrolid", date="svcdate", cost="netpay") -> DataFrame:
    """key, year, annual_cost: deflated costs summed by id and year, the years being those with a factor."""
    rows = claims.where(in_years(date, factors))
    if where is not None:
        rows = rows.where(where)
    year = F.year(date)
    return rows.groupBy(key, year.alias("year")).agg(F.sum(deflated(cost, year, factors)).alias("annual_cost"))


def costs_by_year(costs: DataFrame, baseline: int, outcomes: Sequence[int], key="enrolid") -> DataFrame:
    """One row an id with a baseline cost; one outcome year is joined inner, several left.

    A conditional aggregate in place of self-joins: one pass, one shuffle.
    """
    years = [baseline, *outcomes]
    wide = costs.where(F.col("year").isin(years)).groupBy(key).agg(*(F.sum(F.when(F.col("year") == y, F.col("annual_cost"))).alias(f"annual_cost_{y}") for y in years))
    out = wide.where(F.col(f"annual_cost_{baseline}").isNotNull())
    return out.where(F.col(f"annual_cost_{outcomes[0]}").isNotNull()) if len(outcomes) == 1 else out


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float], accuracy: float | None = None) -> list[float]:
    """Exact quantiles with linear interpolation, or Greenwald-Khanna ones with the relative error ``accuracy``."""
    if accuracy is not None:
        return df.approxQuantile(column, list(probabilities), accuracy)
    return df.agg(F.percentile(F.col(column), F.array(*map(F.lit, probabilities))).alias("q")).first()["q"]


def percent_name(share: float) -> str:
    """10 for 0.1, 0_5 for 0.005."""
    text = f"{share * 100:.4f}".rstrip("0").rstrip(".")
    return text.replace(".", "_")


def top_cost_labels(wide: DataFrame, years: Sequence[int], shares: Sequence[float] = (0.1, 0.05, 0.02), accuracy: float | None = None, combine: bool = False) -> DataFrame:
    """top_<p>_pct_cost_<year> flags (cost at the quantile or above; a null cost gives 0).

    Thresholds come from one aggregate per table, exact or by ``accuracy``, and go back as literals.
    ``combine`` adds top_<p>_pct_cost, set in any of the years.
    """
    cost = lambda y: F.col(f"annual_cost_{y}")
    cuts = {}
    if accuracy is None:
        row = wide.agg(*(F.percentile(cost(y), F.array(*(F.lit(1 - s) for s in shares))).alias(str(y)) for y in years)).first()
        cuts = {y: row[str(y)] for y in years}
    else:
        cuts = {y: wide.where(cost(y).isNotNull()).approxQuantile(f"annual_cost_{y}", [1 - s for s in shares], accuracy) for y in years}
    flags = {f"top_{percent_name(s)}_pct_cost_{y}": F.when(cost(y) >= F.lit(c), 1).otherwise(0) for y in years if cuts[y] for s, c in zip(shares, cuts[y], strict=True)}
    out = wide.withColumns(flags)
    if combine:
        out = out.withColumns({f"top_{percent_name(s)}_pct_cost": F.greatest(F.lit(0), *(F.col(f"top_{percent_name(s)}_pct_cost_{y}") for y in years)) for s in shares})
    return out


def labels_from_name(df: DataFrame, target: str, cost_of=lambda y: f"annual_cost_{y}") -> DataFrame:
    """``target`` added from its name, top_<p>_pct_cost_<year>, where it is missing."""
    import re

    m = re.fullmatch(r"top_([\d_]+)_pct_cost_(\d{4})", target)
    if target in df.columns:
        return df
    if not m:
        raise ValueError(f"not a target name: {target}")
    cost = cost_of(m[2])
    cut = quantiles(df, cost, [1 - float(m[1].replace("_", ".")) / 100])[0]
    return df.withColumn(target, F.when(F.col(cost) >= cut, 1).otherwise(0))


def high_cost_flags(df: DataFrame, cost: str) -> DataFrame:
    return df.withColumns(cutoff_ladder(cost) | {"cost_stratum": cost_stratum(cost)})


def stage_cohort(claims: DataFrame, columns: Sequence[str], stages: Sequence[int], years: tuple[int, int], key="enrolid", date="svcdate") -> DataFrame:
    """Ids with one of the stages in both years: one scan and one aggregate in place of an intersection."""
    rows = claims.where(in_years(date, years)).where(disease_stage(columns).isin(list(stages)))
    first, second = (F.max(F.when(F.year(date) == y, 1)).alias(f"y{y}") for y in years)
    return rows.groupBy(key).agg(first, second).where(f"y{years[0]} = 1 AND y{years[1]} = 1").select(key)


def both_years(a: DataFrame, b: DataFrame, key="enrolid") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def classify_claims(claims: DataFrame, columns: Sequence[str], condition: Sequence[str], comorbid: Sequence[str], procedures: Sequence, procedure: str) -> DataFrame:
    """Flags has_dx, has_proc, has_comorbidity and their claim class; rows with none of them go."""
    flags = {
        "has_dx": F.coalesce(in_any(columns, condition, True).cast("int"), F.lit(0)),
        "has_proc": F.coalesce(F.col(procedure).isin(list(procedures)).cast("int"), F.lit(0)),
        "has_comorbidity": F.coalesce(in_any(columns, comorbid, True).cast("int"), F.lit(0)),
    }
    kind = F.when(F.col("has_dx") == 1, "Direct").when(F.col("has_proc") == 1, "Procedure_Only").when(F.col("has_comorbidity") == 1, "Comorbidity").otherwise("Other")
    return claims.withColumns(flags).where("has_dx + has_proc + has_comorbidity > 0").withColumn("claim_class", kind)


def latest_row(df: DataFrame, key: str, by: Sequence[Column]) -> DataFrame:
    """One whole row an id, the first in the given total order."""
    rest = [c for c in df.columns if c != key]
    rank = Window.partitionBy(key).orderBy(*by)
    return df.withColumn("__n", F.row_number().over(rank)).where("__n = 1").select(key, *rest)


def first_values(df: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Each column's value at the least ``order``, ties by the values: one partial aggregate."""
    pick = F.min(F.struct(F.col(order).alias("__o"), *columns)).alias("s")
    return df.groupBy(key).agg(pick).select(key, *(F.col(f"s.{c}").alias(c) for c in columns))


def utilisation(claims: DataFrame, key="enrolid") -> DataFrame:
    return claims.groupBy(key).agg(F.count(key).alias("n_claims"))


def down_sample(df: DataFrame, target: str, most: int, keep: int, key="enrolid", seed: int = 0) -> DataFrame:
    """Tables of over ``most`` rows cut to about ``keep``, the same share of each stratum, by the hash of the id."""
    counts = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    total = sum(counts.values())
    if total <= most:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1e6
    return df.where(share < keep / total)


def normalized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: normalize_code(c) for c in columns})


def in_order(claims: DataFrame, key="enrolid", date="svcdate") -> DataFrame:
    """All rows by id and date: a range partitioning and a sort within, so no task orders everything."""
    return claims.repartitionByRange(key, date).sortWithinPartitions(key, date)
