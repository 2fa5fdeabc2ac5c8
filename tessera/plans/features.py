"""The end-to-end cohort feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.claims import code_regex, cost_column, diagnosis_columns, in_any, in_years, matches_any, rx_filter
from ..operators.cohort import annual_costs, costs_by_year, first_values, top_cost_labels
from ..operators.costs import annual_sums, derivatives, moments, quarterly, typed_costs
from ..operators.onehot import diagnosis_onehot, medication_onehot, procedure_onehot

MEASURES = ("condition_cost", "procedure_cost", "comorbidity_only_cost")


def cohort_features(
    claims: DataFrame, enrollment: DataFrame, drugs: DataFrame, code: str, baseline: int, outcomes: Sequence[int], factors: dict[int, float], comorbid: Sequence[str], procedures: Sequence, k: int = 5, null_safe: bool = False, key: str = "enrolid", date: str = "svcdate"
) -> DataFrame:
    """One row an id with costs in the baseline and outcome years.

    Costs and labels, diagnosis, procedure and medication flags, quarterly costs with changes, moments
    and patterns, demographics.  Every block is one aggregate by id and the joins are on the id, so all
    of them use one partitioning.  Numeric gaps become 0, text ones stay null.
    """
    dx, cost = diagnosis_columns(claims), cost_column(claims)
    rows = claims.where(in_years(date, [baseline, *outcomes]))
    base = rows.where(in_years(date, [baseline]))
    labels = top_cost_labels(costs_by_year(annual_costs(rows, factors, None, key, date, cost), baseline, outcomes, key), outcomes, combine=len(outcomes) > 1)
    pattern = code_regex(code)
    condition = matches_any(dx, lambda c: c.rlike(pattern), null_safe)
    quarters = quarterly(base, baseline, typed_costs(cost, condition, in_any(dx, comorbid, null_safe), F.col("procgrp").isin(list(procedures)), factors, F.year(date)), key, date)
    quarters = annual_sums(quarters, baseline, MEASURES)
    quarters = quarters.withColumns({n: c for m in MEASURES for n, c in derivatives(baseline, m).items()})
    for m in MEASURES:
        quarters = moments(quarters, baseline, m)
    blocks = [
        diagnosis_onehot(base, key, dx, F.coalesce(F.col("code").rlike(pattern), F.lit(False)), k, 3),
        procedure_onehot(base, key, "procgrp", F.coalesce(condition, F.lit(False)), k),
        medication_onehot(base.where(rx_filter(base)), key, drugs, k),
        quarters,
        first_values(enrollment, key, ["sex", "region", "agegrp"], "agegrp"),
    ]
    out = labels
    for block in blocks:
        out = out.join(block, key, "left")
    return out.na.fill(0)
