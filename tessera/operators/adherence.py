"""Guideline adherence: monitoring, specialist visits, medication coverage, comorbidity care, a composite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.claims import in_years


def lab_monitoring(claims: DataFrame, ids: DataFrame, year: int, is_lab: Column, key="enrolid", date="svcdate") -> DataFrame:
    """Labs and quarters with a lab; adherent from 2 quarters; intensity high/moderate/low from 12/6/3 labs."""
    labs = claims.where(in_years(date, [year]) & is_lab).groupBy(key).agg(F.count("*").alias("n_labs"), F.count_distinct(F.quarter(date)).alias("lab_quarters"))
    out = ids.select(key).distinct().join(labs, key, "left").na.fill(0)
    n = F.col("n_labs")
    return out.withColumns(
        {
            "lab_adherent": F.when(F.col("lab_quarters") >= 2, 1).otherwise(0),
            "lab_intensity": F.when(n >= 12, "high").when(n >= 6, "moderate").when(n >= 3, "low").otherwise("minimal"),
        }
    )


def specialist_visits(claims: DataFrame, ids: DataFrame, start: DataFrame, is_visit: Column, key="enrolid", date="svcdate") -> DataFrame:
    """Visits, the first one, days to it from ``start`` (key, start_date), and whether they are 0 to 90."""
    visits = claims.where(is_visit).groupBy(key).agg(F.count("*").alias("n_visits"), F.min(date).alias("first_visit"))
    out = ids.select(key).distinct().join(start, key, "left").join(visits, key, "left")
    days = F.datediff("first_visit", "start_date")
    return out.select(
        key,
        F.coalesce("n_visits", F.lit(0)).alias("n_visits"),
        days.alias("days_to_visit"),
        F.coalesce(F.when((days >= 0) & (days <= 90), 1).otherwise(0), F.lit(0)).alias("early_referral"),
    )


def medication_coverage(rx: DataFrame, ids: DataFrame, year: int, classes: dict[str, Column], target: float = 0.8, key="enrolid", date="svcdate", days="daysupp") -> DataFrame:
    """By drug class: fills, months with one, days covered over 365 (1 at most) and whether that reaches ``target``.

    All classes come from one conditional aggregate.
    """
    cells = []
    for name, test in classes.items():
        cells += [
            F.count(F.when(test, 1)).alias(f"{name}_fills"),
            F.count_distinct(F.when(test, F.month(date))).alias(f"{name}_months"),
            F.least(F.lit(1.0), F.coalesce(F.sum(F.when(test, F.col(days).cast("double"))), F.lit(0.0)) / 365).alias(f"{name}_pdc"),
        ]
    used = rx.where(in_years(date, [year])).groupBy(key).agg(*cells)
    out = ids.select(key).distinct().join(used, key, "left").na.fill(0)
    return out.withColumns({f"{name}_adherent": F.when(F.col(f"{name}_pdc") >= target, 1).otherwise(0) for name in classes})


def comorbidity_care(claims: DataFrame, ids: DataFrame, year: int, tests: dict[str, tuple[Column, Column, str, int]], key="enrolid", date="svcdate") -> DataFrame:
    """<name>_managed by condition: (has the condition, is its test, 'quarters' or 'count', how many at least)."""
    cells = []
    for name, (has, test, _, _) in tests.items():
        cells += [
            F.max(F.when(has, 1).otherwise(0)).alias(f"has_{name}"),
            F.count(F.when(test, 1)).alias(f"{name}_count"),
            F.count_distinct(F.when(test, F.quarter(date))).alias(f"{name}_quarters"),
        ]
    seen = claims.where(in_years(date, [year])).groupBy(key).agg(*cells)
    out = ids.select(key).distinct().join(seen, key, "left").na.fill(0)
    return out.withColumns({f"{name}_managed": F.when((F.col(f"has_{name}") == 1) & (F.col(f"{name}_{how}") >= least), 1).otherwise(0) for name, (_, _, how, least) in tests.items()})


def composite(df: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Weighted adherence_score of 0/1 columns, its level (0.75, 0.5, 0.25) and the risk that goes with it."""
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
    s = F.col("adherence_score")
    return df.withColumn("adherence_score", score).withColumns(
        {
            "adherence_level": F.when(s >= 0.75, "excellent").when(s >= 0.5, "good").when(s >= 0.25, "fair").otherwise("poor"),
            "adherence_risk": F.when(s >= 0.75, "low").when(s >= 0.25, "moderate").otherwise("high"),
        }
    )


def adherence_summary(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns))
