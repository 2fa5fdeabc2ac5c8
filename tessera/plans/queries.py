"""The registered queries of the operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as fc
from ..functions import names
from ..operators import adherence, cohort, costs, curate, distance, experiments, metrics, onehot, prepare, profile, reports, resample
from ..streaming import events as stream
from . import standins as s
from .features import cohort_features
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

DX = ["dx1", "dx2", "pdx"]
COND, COMORB, PROCS = "PROMO", ("ECONOMY", "Brand#3", "Brand#7"), (1, 2, 3, 4, 5, 10, 20)
Y0, Y1, Y2 = s.BASELINE, s.OUTCOME, s.LATER
DEFL = f"CASE year(svcdate) WHEN 1997 THEN 1.0::DOUBLE WHEN 1998 THEN {s.FACTORS[1998]!r}::DOUBLE WHEN 1999 THEN {s.FACTORS[1999]!r}::DOUBLE END"
ANNUAL = f"annual AS (SELECT enrolid, year(svcdate) AS year, sum(netpay / ({DEFL})) AS annual_cost FROM claims WHERE year(svcdate) IN (1997, 1998, 1999) GROUP BY ALL)"
WIDE2 = "wide AS (SELECT enrolid, sum(annual_cost) FILTER (year = 1997) AS annual_cost_1997, sum(annual_cost) FILTER (year = 1998) AS annual_cost_1998 FROM annual GROUP BY enrolid HAVING count(*) FILTER (year = 1997) > 0 AND count(*) FILTER (year = 1998) > 0)"
WIDE3 = "wide AS (SELECT enrolid, sum(annual_cost) FILTER (year = 1997) AS annual_cost_1997, sum(annual_cost) FILTER (year = 1998) AS annual_cost_1998, sum(annual_cost) FILTER (year = 1999) AS annual_cost_1999 FROM annual GROUP BY enrolid HAVING count(*) FILTER (year = 1997) > 0)"


def _factors(*years):
    return {y: s.FACTORS[y] for y in years}


def _wide(spark, d, *outcomes):
    return cohort.costs_by_year(cohort.annual_costs(s.claims(spark, d), _factors(Y0, *outcomes)), Y0, list(outcomes))


# -- costs and labels -----------------------------------------------------------------------------


@query("SELECT * FROM annual", (s.CLAIMS_SQL, ANNUAL), "annual_cost:4")
def annual_cost(spark, d):
    return cohort.annual_costs(s.claims(spark, d), s.FACTORS)


@query(
    """SELECT wide.*, CAST(annual_cost_1998 >= q[1] AS INT) AS top_10_pct_cost_1998, CAST(annual_cost_1998 >= q[2] AS INT) AS top_5_pct_cost_1998, CAST(annual_cost_1998 >= q[3] AS INT) AS top_2_pct_cost_1998
    FROM wide, (SELECT quantile_cont(annual_cost_1998, [0.9, 0.95, 0.98]) AS q FROM wide)""",
    (s.CLAIMS_SQL, ANNUAL, WIDE2),
    "annual_cost_1997:4 annual_cost_1998:4",
)
def annual_cost_labels(spark, d):
    return cohort.top_cost_labels(_wide(spark, d, Y1), [Y1])


@query(
    """SELECT enrolid, annual_cost_1997, annual_cost_1998, annual_cost_1999,
      CAST(coalesce(annual_cost_1998 >= q8, false) AS INT) AS top_10_pct_cost_1998, CAST(coalesce(annual_cost_1999 >= q9, false) AS INT) AS top_10_pct_cost_1999,
      CAST(coalesce(annual_cost_1998 >= q8, false) OR coalesce(annual_cost_1999 >= q9, false) AS INT) AS top_10_pct_cost
    FROM wide, (SELECT quantile_cont(annual_cost_1998, 0.9) AS q8, quantile_cont(annual_cost_1999, 0.9) AS q9 FROM wide)""",
    (s.CLAIMS_SQL, ANNUAL, WIDE3),
    "annual_cost_1997:4 annual_cost_1998:4 annual_cost_1999:4",
)
def dual_year_labels(spark, d):
    return cohort.top_cost_labels(_wide(spark, d, Y1, Y2), [Y1, Y2], shares=(0.1,), combine=True)


@query("SELECT enrolid, CAST(annual_cost_1998 >= (SELECT quantile_cont(annual_cost_1998, 0.995) FROM wide) AS INT) AS top_0_5_pct_cost_1998 FROM wide", (s.CLAIMS_SQL, ANNUAL, WIDE2))
def target_from_name(spark, d):
    return cohort.labels_from_name(_wide(spark, d, Y1), "top_0_5_pct_cost_1998").select("enrolid", "top_0_5_pct_cost_1998")


@query()
def approximate_labels(spark, d):
    return cohort.top_cost_labels(_wide(spark, d, Y1), [Y1], accuracy=0.001)


@query(
    """SELECT enrolid, """ + ", ".join(f"CAST(annual_cost_1998 > {k}000 AS INT) AS gt_{k}k" for k in (50, 75, 100, 200, 300, 400, 500)) + """,
    CASE WHEN annual_cost_1998 >= 200000 THEN 3 WHEN annual_cost_1998 >= 100000 THEN 2 WHEN annual_cost_1998 >= 50000 THEN 1 ELSE 0 END AS cost_stratum FROM wide""",
    (s.CLAIMS_SQL, ANNUAL, WIDE2),
)
def high_cost_ladder(spark, d):
    return cohort.high_cost_flags(_wide(spark, d, Y1), "annual_cost_1998").drop("annual_cost_1997", "annual_cost_1998")


@query("SELECT enrolid, sum(netpay) AS rx_cost, count(*) AS n_rx FROM claims WHERE claim_type = 'RX' AND svcdate >= '1997-01-01' AND svcdate < '1998-01-01' GROUP BY enrolid", (s.CLAIMS_SQL,), "rx_cost:4")
def rx_costs(spark, d):
    c = s.claims(spark, d)
    return c.where(fc.rx_filter(c) & fc.in_years("svcdate", [Y0])).groupBy("enrolid").agg(F.sum("netpay").alias("rx_cost"), F.count("*").alias("n_rx"))


@query("SELECT enrolid, count(*) AS n_claims FROM claims GROUP BY enrolid", (s.CLAIMS_SQL,))
def utilisation(spark, d):
    return cohort.utilisation(s.claims(spark, d))


@query("SELECT CAST(CASE WHEN annual_cost >= 500000 THEN 500000 WHEN annual_cost >= 200000 THEN 200000 WHEN annual_cost >= 50000 THEN 50000 ELSE 0 END AS DOUBLE) AS low, count(*) AS n FROM annual GROUP BY 1", (s.CLAIMS_SQL, ANNUAL))
def cost_histogram(spark, d):
    return costs.cost_histogram(cohort.annual_costs(s.claims(spark, d), s.FACTORS), "annual_cost", [0, 50_000, 200_000, 500_000])


# -- cohorts and sets -----------------------------------------------------------------------------

STAGED = """staged AS (SELECT enrolid, svcdate, CASE procgrp % 10 WHEN 9 THEN 'N189' WHEN 8 THEN 'I10' ELSE 'N18' || CAST(procgrp % 7 AS VARCHAR) END AS dx1, CASE WHEN procgrp % 4 = 0 THEN 'N183' END AS dx2 FROM claims)"""


def _staged(spark, d):
    c = s.claims(spark, d)
    m = F.col("procgrp") % 10
    return c.select("enrolid", "svcdate", F.when(m == 9, "N189").when(m == 8, "I10").otherwise(F.concat(F.lit("N18"), (F.col("procgrp") % 7).cast("string"))).alias("dx1"), F.when(F.col("procgrp") % 4 == 0, "N183").alias("dx2"))


_STAGE = "coalesce(CASE WHEN {0} = 'N189' THEN 0 ELSE TRY_CAST(nullif(regexp_extract({0}, 'N18([1-6]).*', 1), '') AS INT) END, NULL)"
STAGE = f"coalesce({_STAGE.format('dx1')}, {_STAGE.format('dx2')})"


@query(f"SELECT {STAGE} AS stage, count(*) AS n FROM staged GROUP BY 1", (s.CLAIMS_SQL, STAGED))
def disease_stage(spark, d):
    return _staged(spark, d).groupBy(fc.disease_stage(["dx1", "dx2"]).alias("stage")).agg(F.count("*").alias("n"))


@query(f"SELECT enrolid FROM staged WHERE {STAGE} IN (3, 4) AND year(svcdate) = 1997 INTERSECT SELECT enrolid FROM staged WHERE {STAGE} IN (3, 4) AND year(svcdate) = 1998", (s.CLAIMS_SQL, STAGED))
def stage_cohort(spark, d):
    return cohort.stage_cohort(_staged(spark, d), ["dx1", "dx2"], (3, 4), (Y0, Y1))


@query("SELECT enrolid FROM claims WHERE year(svcdate) = 1997 INTERSECT SELECT enrolid FROM claims WHERE year(svcdate) = 1998", (s.CLAIMS_SQL,))
def both_years(spark, d):
    c = s.claims(spark, d)
    return cohort.both_years(c.where(fc.in_years("svcdate", [Y0])), c.where(fc.in_years("svcdate", [Y1])))


@query(
    """SELECT claim_class, count(*) AS n, sum(netpay) AS cost FROM (SELECT netpay, CASE WHEN hd THEN 'Direct' WHEN hp THEN 'Procedure_Only' WHEN hc THEN 'Comorbidity' ELSE 'Other' END AS claim_class
    FROM (SELECT *, coalesce(dx1 = 'PROMO', false) OR coalesce(dx2 = 'PROMO', false) OR coalesce(pdx = 'PROMO', false) AS hd, procgrp IN (1, 2, 3, 4, 5, 10, 20) AS hp,
    coalesce(dx1 IN ('ECONOMY', 'Brand#3', 'Brand#7'), false) OR coalesce(dx2 IN ('ECONOMY', 'Brand#3', 'Brand#7'), false) OR coalesce(pdx IN ('ECONOMY', 'Brand#3', 'Brand#7'), false) AS hc FROM claims) WHERE hd OR hp OR hc) GROUP BY claim_class""",
    (s.CLAIMS_SQL,),
    "cost:4",
)
def claim_classes(spark, d):
    return cohort.classify_claims(s.claims(spark, d), DX, [COND], COMORB, PROCS, "procgrp").groupBy("claim_class").agg(F.count("*").alias("n"), F.sum("netpay").alias("cost"))


@query("SELECT enrolid, count(*) AS n FROM claims WHERE enrolid IN (SELECT enrolid FROM enrollment WHERE region = 'ASIA') GROUP BY enrolid", (s.CLAIMS_SQL, s.ENROLLMENT_SQL))
def member_claims(spark, d):
    ids = s.enrollment(spark, d).where("region = 'ASIA'")
    return cohort.members_only(s.claims(spark, d), ids).groupBy("enrolid").agg(F.count("*").alias("n"))


@query("SELECT enrolid FROM enrollment WHERE enrolid NOT IN (SELECT enrolid FROM claims WHERE year(svcdate) = 1997)", (s.CLAIMS_SQL, s.ENROLLMENT_SQL))
def members_without_claims(spark, d):
    return cohort.without_members(s.enrollment(spark, d), s.claims(spark, d).where(fc.in_years("svcdate", [Y0]))).select("enrolid")


@query(
    """SELECT count(*) FILTER (m IN (1, 3)) AS n_a, count(*) FILTER (m IN (2, 3)) AS n_b, count(*) FILTER (m = 3) AS n_both, count(*) FILTER (m = 1) AS n_only_a, count(*) FILTER (m = 2) AS n_only_b, CAST(count(*) FILTER (m = 3) AS DOUBLE) / count(*) AS jaccard
    FROM (SELECT enrolid, sum(k) AS m FROM (SELECT DISTINCT enrolid, 1 AS k FROM claims WHERE year(svcdate) = 1997 UNION ALL SELECT DISTINCT enrolid, 2 FROM claims WHERE year(svcdate) = 1999) GROUP BY enrolid)""",
    (s.CLAIMS_SQL,),
    "jaccard:9",
)
def set_relations(spark, d):
    c = s.claims(spark, d)
    return profile.set_relations(c.where(fc.in_years("svcdate", [Y0])), c.where(fc.in_years("svcdate", [Y2])), "enrolid")


@query("SELECT enrolid, svcdate, procgrp FROM (SELECT *, row_number() OVER (PARTITION BY enrolid ORDER BY svcdate DESC, procgrp, netpay, dx2) AS k FROM claims) WHERE k = 1", (s.CLAIMS_SQL,))
def latest_claim(spark, d):
    c = s.claims(spark, d).select("enrolid", "svcdate", "procgrp", "netpay", "dx2")
    return cohort.latest_row(c, "enrolid", [F.desc("svcdate"), F.col("procgrp"), F.col("netpay"), F.col("dx2")]).select("enrolid", "svcdate", "procgrp")


@query("SELECT enrolid, sex, region FROM enrollment", (s.ENROLLMENT_SQL,))
def demographics(spark, d):
    return cohort.first_values(s.enrollment(spark, d), "enrolid", ["sex", "region"], "agegrp")


# -- codes ----------------------------------------------------------------------------------------

CODES = "codes AS (SELECT enrolid, unnest([upper(replace(trim(dx1), '.', '')), upper(replace(trim(dx2), '.', '')), upper(replace(trim(pdx), '.', ''))]) AS code FROM claims WHERE year(svcdate) = 1997)"


def _base(spark, d):
    return s.claims(spark, d).where(fc.in_years("svcdate", [Y0]))


@query("SELECT substr(code, 1, 3) AS code, count(*) AS n FROM codes WHERE code IS NOT NULL GROUP BY 1", (s.CLAIMS_SQL, CODES))
def code_counts(spark, d):
    return onehot.counts_of(onehot.exploded_codes(_base(spark, d), "enrolid", DX, 3), "code")


@query("SELECT pdx AS code FROM (SELECT pdx, count(*) AS n FROM claims GROUP BY pdx ORDER BY n DESC, pdx NULLS LAST LIMIT 4) WHERE pdx IS NOT NULL", (s.CLAIMS_SQL,))
def top_codes_with_null(spark, d):
    return spark.createDataFrame([(x,) for x in onehot.top_k(s.claims(spark, d), "pdx", 4)], "code string")


@query(
    """SELECT enrolid, """ + ", ".join(f"max(CAST(code = '{c}' AS INT)) AS has_{c.lower()}" for c in ("ECONOMY", "PROMO", "SMALL")) + " FROM codes WHERE code IN ('ECONOMY', 'PROMO', 'SMALL') GROUP BY enrolid",
    (s.CLAIMS_SQL, CODES),
)
def code_onehot(spark, d):
    codes = onehot.exploded_codes(_base(spark, d), "enrolid", DX)
    return onehot.onehot(codes, "enrolid", "code", ["ECONOMY", "PROMO", "SMALL"], lambda v: f"has_{v.lower()}")


@query(
    """SELECT enrolid, CASE WHEN cond THEN 'has_cond_' ELSE 'has_comorb_' END || short AS feature, CAST(max(CAST(c.code IS NOT NULL AND starts_with(c.code, short) AND regexp_matches(c.code, '^PRO') = cond AS INT)) AS DOUBLE) AS value
    FROM codes c, (SELECT regexp_matches(code, '^PRO') AS cond, substr(code, 1, 3) AS short FROM codes WHERE code IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cond ORDER BY count(*) DESC, short) <= 5)
    WHERE c.code IS NOT NULL GROUP BY enrolid, cond, short""",
    (s.CLAIMS_SQL, CODES),
)
def icd_onehot_topk(spark, d):
    flags = onehot.diagnosis_onehot(_base(spark, d), "enrolid", DX, F.coalesce(F.col("code").rlike("^PRO"), F.lit(False)), 5)
    return profile.long_form(flags, ["enrolid"], flags.columns[1:])


@query(
    """SELECT enrolid, max(CAST(procgrp = g[1] AS INT)) AS p1, max(CAST(procgrp = g[2] AS INT)) AS p2, max(CAST(procgrp = g[3] AS INT)) AS p3 FROM claims,
    (SELECT list(procgrp ORDER BY n DESC, CAST(procgrp AS VARCHAR)) AS g FROM (SELECT procgrp, count(*) AS n FROM claims WHERE dx1 = 'PROMO' AND year(svcdate) = 1997 GROUP BY 1 ORDER BY n DESC, CAST(procgrp AS VARCHAR) LIMIT 3))
    WHERE year(svcdate) = 1997 AND list_contains(g, procgrp) GROUP BY enrolid""",
    (s.CLAIMS_SQL,),
)
def procedure_onehot(spark, d):
    out = onehot.procedure_onehot(_base(spark, d), "enrolid", "procgrp", F.col("dx1") == "PROMO", 3)
    return out.select("enrolid", *(F.col(c).alias(f"p{i + 1}") for i, c in enumerate(out.columns[1:])))


MEDS = "one AS (SELECT thercls, min(thergrp) AS g FROM redbook GROUP BY 1), used AS (SELECT enrolid, thercls FROM claims WHERE claim_type = 'RX' AND year(svcdate) = 1997), cls AS (SELECT thercls FROM used GROUP BY 1 ORDER BY count(*) DESC, thercls LIMIT 5)"


@query("SELECT enrolid, list_sort(list(DISTINCT g)) AS groups FROM used JOIN cls USING (thercls) JOIN one USING (thercls) GROUP BY enrolid", (s.CLAIMS_SQL, s.REDBOOK_SQL, MEDS))
def medication_groups(spark, d):
    rx = _base(spark, d).where("claim_type = 'RX'")
    flags = onehot.medication_onehot(rx, "enrolid", s.redbook(spark, d), 5)
    return flags.select("enrolid", F.array_sort(F.array_compact(F.array(*(F.when(F.col(c) == 1, c.removeprefix("med_has_")) for c in flags.columns[1:])))).alias("groups"))


@query(
    "SELECT enrolid, primary_value, n FROM (SELECT enrolid, dx2 AS primary_value, count(*) AS n, row_number() OVER (PARTITION BY enrolid ORDER BY count(*) DESC, dx2) AS k FROM claims GROUP BY enrolid, dx2) WHERE k = 1",
    (s.CLAIMS_SQL,),
)
def primary_category(spark, d):
    return onehot.primary_category(s.claims(spark, d), "enrolid", "dx2")


@query("SELECT CASE WHEN regexp_matches(dx1, '^(PROMO|ECON)') THEN 'Sale' WHEN regexp_matches(dx1, '^S') THEN 'Size' ELSE 'Other' END AS category, count(*) AS n FROM claims GROUP BY 1", (s.CLAIMS_SQL,))
def regex_category(spark, d):
    return s.claims(spark, d).groupBy(onehot.regex_category("dx1", [("^(PROMO|ECON)", "Sale"), ("^S", "Size")]).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT CASE dx1 WHEN 'PROMO' THEN 'P' WHEN 'ECONOMY' THEN 'E' ELSE dx1 END AS bucket, count(*) AS n FROM claims GROUP BY 1", (s.CLAIMS_SQL,))
def bucketed_codes(spark, d):
    return s.claims(spark, d).groupBy(onehot.bucketed_code("dx1", {"PROMO": "P", "ECONOMY": "E"}).alias("bucket")).agg(F.count("*").alias("n"))


# -- quarterly costs ------------------------------------------------------------------------------

COND_SQL = "(regexp_matches(dx1, '^PROMO') OR regexp_matches(dx2, '^PROMO') OR regexp_matches(pdx, '^PROMO'))"
COMORB_SQL = "(dx1 IN ('ECONOMY', 'Brand#3', 'Brand#7') OR dx2 IN ('ECONOMY', 'Brand#3', 'Brand#7') OR pdx IN ('ECONOMY', 'Brand#3', 'Brand#7'))"
TYPED = f"""typed AS (SELECT enrolid, quarter(svcdate) AS q, CASE WHEN {COND_SQL} THEN netpay ELSE 0 END AS condition_cost, CASE WHEN procgrp IN (1, 2, 3, 4, 5, 10, 20) THEN netpay ELSE 0 END AS procedure_cost,
  CASE WHEN {COMORB_SQL} AND NOT {COND_SQL} THEN netpay ELSE 0 END AS comorbidity_only_cost, 1 AS total_claims FROM claims WHERE year(svcdate) = 1997)"""
_M = ("condition_cost", "procedure_cost", "comorbidity_only_cost", "total_claims")
QUARTERS = "quarters AS (SELECT enrolid, " + ", ".join(f"coalesce(sum({m}) FILTER (q = {q}), 0) AS \"1997Q{q}_{m}\"" for q in (1, 2, 3, 4) for m in _M) + " FROM typed GROUP BY enrolid)"


def _quarters(spark, d):
    base = _base(spark, d)
    condition = fc.matches_any(DX, lambda c: c.rlike("^PROMO"))
    return costs.quarterly(base, Y0, costs.typed_costs("netpay", condition, fc.in_any(DX, COMORB), F.col("procgrp").isin(*PROCS), {Y0: 1.0}, F.year("svcdate")))


@query("SELECT enrolid, " + ", ".join(f'CAST(round("1997Q{q}_{m}", 4) AS {"BIGINT" if m == "total_claims" else "DOUBLE"}) AS "q{q}_{m}"' for q in (1, 2, 3, 4) for m in _M) + " FROM quarters", (s.CLAIMS_SQL, TYPED, QUARTERS))
def quarterly_typed_costs(spark, d):
    return _quarters(spark, d).select("enrolid", *(F.round(f"1997Q{q}_{m}", 4).cast("bigint" if m == "total_claims" else "double").alias(f"q{q}_{m}") for q in (1, 2, 3, 4) for m in _M))


_C = [f'"1997Q{q}_procedure_cost"' for q in (1, 2, 3, 4)]


@query(
    f"""SELECT enrolid, {_C[1]} - {_C[0]} AS d12, {_C[2]} - {_C[1]} AS d23, {_C[3]} - {_C[2]} AS d34, CAST({_C[1]} > {_C[0]} AS INT) + CAST({_C[2]} > {_C[1]} AS INT) + CAST({_C[3]} > {_C[2]} AS INT) AS rises,
    CAST({_C[1]} > {_C[0]} AND {_C[2]} > {_C[1]} AND {_C[3]} > {_C[2]} AS INT) AS up, CAST(NOT ({_C[1]} > {_C[0]} OR {_C[2]} > {_C[1]} OR {_C[3]} > {_C[2]}) AS INT) AS down, ({_C[3]} - {_C[0]}) / 3 AS mean_change FROM quarters""",
    (s.CLAIMS_SQL, TYPED, QUARTERS),
    "d12:4 d23:4 d34:4 mean_change:4",
)
def quarterly_derivatives(spark, d):
    m = "procedure_cost"
    out = _quarters(spark, d).withColumns(costs.derivatives(Y0, m))
    names = {f"{m}_deriv_Q1_Q2_1997": "d12", f"{m}_deriv_Q2_Q3_1997": "d23", f"{m}_deriv_Q3_Q4_1997": "d34", f"{m}_total_increasing_1997": "rises", f"{m}_consistently_increasing_1997": "up", f"{m}_consistently_decreasing_1997": "down", f"{m}_mean_deriv_1997": "mean_change"}
    return out.select("enrolid", *(F.col(a).alias(b) for a, b in names.items()))


MOMENTS = f"""m0 AS (SELECT enrolid, [{', '.join(_C)}] AS c FROM quarters), m1 AS (SELECT *, list_sum(c) / 4 AS mean FROM m0), m2 AS (SELECT *, sqrt(list_sum([(x - mean) * (x - mean) FOR x IN c]) / 4) AS std FROM m1),
  m3 AS (SELECT *, CASE WHEN std > 0 THEN list_sum([((x - mean) / std) ** 3 FOR x IN c]) / 4 ELSE 0 END AS skew, CASE WHEN std > 0 THEN list_sum([((x - mean) / std) ** 4 FOR x IN c]) / 4 - 3 ELSE 0 END AS kurt, CASE WHEN mean > 0 THEN std / mean ELSE 0 END AS cv FROM m2)"""


@query(
    """SELECT enrolid, skew, kurt, cv, list_max(c) AS largest, list_min(c) AS smallest, list_max(c) - list_min(c) AS spread, CASE WHEN skew > 0.5 THEN 'late_heavy' WHEN skew < -0.5 THEN 'early_heavy' ELSE 'balanced' END AS pattern,
    CASE WHEN cv < 0.3 THEN 'stable' WHEN cv > 1.0 THEN 'highly_volatile' ELSE 'moderate' END AS stability FROM m3""",
    (s.CLAIMS_SQL, TYPED, QUARTERS, MOMENTS),
    "skew:6 kurt:6 cv:6 largest:4 smallest:4 spread:4",
)
def quarterly_moments(spark, d):
    m = "procedure_cost"
    out = costs.moments(_quarters(spark, d), Y0, m)
    names = {f"{m}_quarterly_skewness_1997": "skew", f"{m}_quarterly_kurtosis_1997": "kurt", f"{m}_quarterly_cv_1997": "cv", f"{m}_quarterly_max_1997": "largest", f"{m}_quarterly_min_1997": "smallest", f"{m}_quarterly_range_1997": "spread", f"{m}_pattern_1997": "pattern", f"{m}_stability_1997": "stability"}
    return out.select("enrolid", *(F.col(a).alias(b) for a, b in names.items()))


@query("SELECT enrolid, list_sum(c) AS total, c[4] - c[1] AS trend, std AS volatility FROM m3", (s.CLAIMS_SQL, TYPED, QUARTERS, MOMENTS), "total:4 trend:4 volatility:4")
def wide_cost_features(spark, d):
    out = costs.wide_cost_features(_quarters(spark, d), Y0, "procedure_cost")
    return out.select("enrolid", *(F.col(f"procedure_cost_{n}_1997").alias(n) for n in ("total", "trend", "volatility")))


@query(
    f"""SELECT pattern, stability, count(*) AS n, avg(c[1]) AS mean_cost, avg(CAST(c[2] > c[1] AND c[3] > c[2] AND c[4] > c[3] AS INT)) AS share_increasing, avg(CAST(NOT (c[2] > c[1] OR c[3] > c[2] OR c[4] > c[3]) AS INT)) AS share_decreasing
    FROM (SELECT c, CASE WHEN skew > 0.5 THEN 'late_heavy' WHEN skew < -0.5 THEN 'early_heavy' ELSE 'balanced' END AS pattern, CASE WHEN cv < 0.3 THEN 'stable' WHEN cv > 1.0 THEN 'highly_volatile' ELSE 'moderate' END AS stability FROM m3) GROUP BY ALL""",
    (s.CLAIMS_SQL, TYPED, QUARTERS, MOMENTS),
    "mean_cost:4 share_increasing:6 share_decreasing:6",
)
def cost_pattern_report(spark, d):
    m = "procedure_cost"
    rows = costs.moments(_quarters(spark, d).withColumns(costs.derivatives(Y0, m)), Y0, m)
    return costs.pattern_report(rows, Y0, m, "1997Q1_procedure_cost")


@query()
def cohort_feature_table(spark, d):
    return cohort_features(s.claims(spark, d), s.enrollment(spark, d), s.redbook(spark, d), COND, Y0, [Y1], s.FACTORS, COMORB, PROCS)


# -- adherence ------------------------------------------------------------------------------------

IDS = "ids AS (SELECT enrolid FROM enrollment)"


@query(
    """SELECT enrolid, coalesce(n_labs, 0) AS n_labs, coalesce(lab_quarters, 0) AS lab_quarters, CAST(coalesce(lab_quarters, 0) >= 2 AS INT) AS lab_adherent,
    CASE WHEN n_labs >= 12 THEN 'high' WHEN n_labs >= 6 THEN 'moderate' WHEN n_labs >= 3 THEN 'low' ELSE 'minimal' END AS lab_intensity
    FROM ids LEFT JOIN (SELECT enrolid, count(*) AS n_labs, count(DISTINCT quarter(svcdate)) AS lab_quarters FROM claims WHERE procgrp <= 10 AND year(svcdate) = 1997 GROUP BY enrolid) USING (enrolid)""",
    (s.CLAIMS_SQL, s.ENROLLMENT_SQL, IDS),
)
def lab_monitoring(spark, d):
    return adherence.lab_monitoring(s.claims(spark, d), s.enrollment(spark, d), Y0, F.col("procgrp") <= 10)


@query(
    """SELECT enrolid, coalesce(n_visits, 0) AS n_visits, CAST(date_diff('day', CAST(start_date AS DATE), CAST(first_visit AS DATE)) AS INT) AS days_to_visit, CAST(coalesce(date_diff('day', CAST(start_date AS DATE), CAST(first_visit AS DATE)) BETWEEN 0 AND 90, false) AS INT) AS early_referral
    FROM ids LEFT JOIN (SELECT enrolid, min(svcdate) AS start_date FROM claims WHERE dx1 = 'PROMO' GROUP BY 1) USING (enrolid) LEFT JOIN (SELECT enrolid, count(*) AS n_visits, min(svcdate) AS first_visit FROM claims WHERE procgrp = 39 GROUP BY 1) USING (enrolid)""",
    (s.CLAIMS_SQL, s.ENROLLMENT_SQL, IDS),
)
def specialist_visits(spark, d):
    c = s.claims(spark, d)
    start = c.where("dx1 = 'PROMO'").groupBy("enrolid").agg(F.min("svcdate").alias("start_date"))
    return adherence.specialist_visits(c, s.enrollment(spark, d), start, F.col("procgrp") == 39)


@query(
    """SELECT enrolid, coalesce(a_fills, 0) AS a_fills, coalesce(a_months, 0) AS a_months, coalesce(a_pdc, 0) AS a_pdc, CAST(coalesce(a_pdc, 0) >= 0.5 AS INT) AS a_adherent FROM ids LEFT JOIN
    (SELECT enrolid, count(*) FILTER (x) AS a_fills, count(DISTINCT CASE WHEN x THEN month(svcdate) END) AS a_months, least(1.0, coalesce(sum(daysupp) FILTER (x), 0) / 365) AS a_pdc FROM (SELECT *, procgrp % 2 = 0 AS x FROM claims WHERE claim_type = 'RX' AND year(svcdate) = 1997) GROUP BY enrolid) USING (enrolid)""",
    (s.CLAIMS_SQL, s.ENROLLMENT_SQL, IDS),
    "a_pdc:9",
)
def medication_coverage(spark, d):
    return adherence.medication_coverage(s.claims(spark, d).where("claim_type = 'RX'"), s.enrollment(spark, d), Y0, {"a": F.col("procgrp") % 2 == 0}, 0.5)


@query(
    """SELECT enrolid, coalesce(has_x, 0) AS has_x, coalesce(x_count, 0) AS x_count, coalesce(x_quarters, 0) AS x_quarters, CAST(coalesce(has_x, 0) = 1 AND coalesce(x_quarters, 0) >= 3 AS INT) AS x_managed FROM ids LEFT JOIN
    (SELECT enrolid, max(CAST(dx1 = 'ECONOMY' AS INT)) AS has_x, count(*) FILTER (procgrp < 25) AS x_count, count(DISTINCT CASE WHEN procgrp < 25 THEN quarter(svcdate) END) AS x_quarters FROM claims WHERE year(svcdate) = 1997 GROUP BY enrolid) USING (enrolid)""",
    (s.CLAIMS_SQL, s.ENROLLMENT_SQL, IDS),
)
def comorbidity_care(spark, d):
    return adherence.comorbidity_care(s.claims(spark, d), s.enrollment(spark, d), Y0, {"x": (F.col("dx1") == "ECONOMY", F.col("procgrp") < 25, "quarters", 3)})


@query(
    """SELECT adherence_level, count(*) AS n, avg(adherence_score) AS mean_adherence_score FROM (SELECT CASE WHEN s >= 0.75 THEN 'excellent' WHEN s >= 0.5 THEN 'good' WHEN s >= 0.25 THEN 'fair' ELSE 'poor' END AS adherence_level, s AS adherence_score FROM
    (SELECT enrolid, 0.6 * CAST(count(DISTINCT CASE WHEN procgrp <= 10 AND year(svcdate) = 1997 THEN quarter(svcdate) END) >= 2 AS INT) + 0.4 * CAST(count(*) FILTER (procgrp = 39) > 0 AS INT) AS s FROM ids LEFT JOIN claims USING (enrolid) GROUP BY enrolid)) GROUP BY 1""",
    (s.CLAIMS_SQL, s.ENROLLMENT_SQL, IDS),
    "mean_adherence_score:6",
)
def adherence_composite(spark, d):
    labs = lab_monitoring(spark, d).select("enrolid", "lab_adherent")
    seen = specialist_visits(spark, d).select("enrolid", (F.col("n_visits") > 0).cast("int").alias("seen"))
    return adherence.adherence_summary(adherence.composite(labs.join(seen, "enrolid"), {"lab_adherent": 0.6, "seen": 0.4}), "adherence_level", ["adherence_score"])


# -- profiling ------------------------------------------------------------------------------------

MIXED = "mixed AS (SELECT enrolid, sex, region, agegrp, income, CAST(income > 5000 AS INT) AS has_income, CAST(enrolid % 2 AS INT) AS odd FROM enrollment)"


def _mixed(spark, d):
    return s.enrollment(spark, d).withColumns({"has_income": (F.col("income") > 5000).cast("int"), "odd": (F.col("enrolid") % 2).cast("int")})


@query("SELECT unnest(['has_income', 'odd']) AS name")
def binary_columns(spark, d):
    return spark.createDataFrame([(c,) for c in profile.binary_columns(_mixed(spark, d))], "name string")


@query("SELECT unnest([{'name': 'sex', 'kind': 'categorical'}, {'name': 'region', 'kind': 'categorical'}, {'name': 'has_income', 'kind': 'binary'}, {'name': 'odd', 'kind': 'binary'}, {'name': 'agegrp', 'kind': 'numeric'}, {'name': 'income', 'kind': 'numeric'}], recursive := true)")
def column_roles(spark, d):
    return spark.createDataFrame([(c, k) for k, cs in profile.column_roles(_mixed(spark, d), "enrolid").items() for c in cs], "name string, kind string")


@query(
    "SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max FROM (SELECT 'netpay' AS feature, netpay AS value FROM claims UNION ALL SELECT 'daysupp', daysupp FROM claims) GROUP BY feature",
    (s.CLAIMS_SQL,),
    "mean:4 std:4 min:2 q25:4 q50:4 q75:4 max:2",
)
def described(spark, d):
    return profile.described(s.claims(spark, d), ["netpay", "daysupp"])


@query("SELECT region, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM enrollment GROUP BY region", (s.ENROLLMENT_SQL,), "share:9")
def value_shares(spark, d):
    return profile.value_shares(s.enrollment(spark, d), "region")


@query("SELECT dx1, count(*) AS n, avg(netpay) AS mean, stddev_samp(netpay) AS std, quantile_cont(netpay, 0.5) AS median FROM claims GROUP BY dx1", (s.CLAIMS_SQL,), "mean:4 std:4 median:4")
def cost_by_category(spark, d):
    return profile.by_category(s.claims(spark, d), "dx1", "netpay")


@query("SELECT unnest(['procgrp', 'daysupp']) AS feature, unnest([corr(procgrp, netpay), corr(daysupp, netpay)]) AS r FROM claims", (s.CLAIMS_SQL,), "r:9")
def target_correlations(spark, d):
    return profile.target_correlations(s.claims(spark, d), "netpay", ["procgrp", "daysupp"])


@query("SELECT unnest(['procgrp', 'procgrp', 'daysupp']) AS a, unnest(['daysupp', 'netpay', 'netpay']) AS b, unnest([corr(procgrp, daysupp), corr(procgrp, netpay), corr(daysupp, netpay)]) AS r FROM claims", (s.CLAIMS_SQL,), "r:9")
def pair_correlations(spark, d):
    return profile.pair_correlations(s.claims(spark, d), ["procgrp", "daysupp", "netpay"])


@query(
    """SELECT feature, sum(n / nn * ln(n * nn / (nb * ny))) AS mi FROM (SELECT feature, n, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM
    (SELECT feature, y, least(9, floor((value - lo) / (hi - lo) * 10)) AS bin, CAST(count(*) AS DOUBLE) AS n FROM (SELECT 'score' AS feature, y, score AS value FROM scored UNION ALL SELECT 'score_b', y, score_b FROM scored) JOIN
    (SELECT 'score' AS feature, min(score) AS lo, max(score) AS hi FROM scored UNION ALL SELECT 'score_b', min(score_b), max(score_b) FROM scored) USING (feature) GROUP BY ALL)) GROUP BY feature""",
    (s.SCORED_SQL,),
    "mi:9",
)
def binned_information(spark, d):
    return profile.binned_information(s.scored(spark, d), "y", ["score", "score_b"])


@query(
    "SELECT g AS \"group\", f AS feature, mi FROM (SELECT dx1 AS g, dx2 AS f, sum(netpay) AS mi, row_number() OVER (PARTITION BY dx1 ORDER BY sum(netpay) DESC, dx2) <= 2 AS in_quota FROM claims GROUP BY 1, 2) ORDER BY in_quota DESC, mi DESC, f LIMIT 20",
    (s.CLAIMS_SQL,),
    "mi:4",
)
def quota_selected(spark, d):
    scores = s.claims(spark, d).groupBy(F.col("dx1").alias("group"), F.col("dx2").alias("feature")).agg(F.sum("netpay").alias("mi"))
    groups = [r[0] for r in scores.select("group").distinct().collect()]
    return profile.quota_selected(scores, {g: 2 for g in groups}, 20)


@query(
    "SELECT feature, avg(value) FILTER (odd = 1) AS mean_a, avg(value) FILTER (odd = 0) AS mean_b, avg(value) FILTER (odd = 1) - avg(value) FILTER (odd = 0) AS delta FROM (SELECT odd, 'income' AS feature, income AS value FROM mixed UNION ALL SELECT odd, 'has_income', has_income FROM mixed) GROUP BY feature",
    (s.ENROLLMENT_SQL, MIXED),
    "mean_a:6 mean_b:6 delta:6",
)
def prevalence_delta(spark, d):
    return profile.prevalence_delta(_mixed(spark, d), "odd", ["income", "has_income"])


# -- preparation ----------------------------------------------------------------------------------


@query(
    """SELECT enrolid, odd, CASE WHEN r <= round(n * 0.7) THEN 'train' WHEN r <= round(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM
    (SELECT enrolid, odd, row_number() OVER (PARTITION BY odd ORDER BY sha256('0:' || CAST(enrolid AS VARCHAR)), enrolid) AS r, count(*) OVER (PARTITION BY odd) AS n FROM mixed)""",
    (s.ENROLLMENT_SQL, MIXED),
)
def stratified_split(spark, d):
    return prepare.stratified_split(_mixed(spark, d), "odd")


@query(
    """SELECT enrolid, CAST(region = 'AMERICA' AS DOUBLE) AS region_AMERICA, CAST(region = 'ASIA' AS DOUBLE) AS region_ASIA, CAST(region = 'EUROPE' AS DOUBLE) AS region_EUROPE, CAST(region = 'MIDDLE EAST' AS DOUBLE) AS "region_MIDDLE EAST",
    (income - (SELECT avg(income) FROM mixed)) / (SELECT stddev_pop(income) FROM mixed) AS income, CAST(odd AS DOUBLE) AS odd FROM mixed""",
    (s.ENROLLMENT_SQL, MIXED),
    "income:6",
)
def preprocessed(spark, d):
    rows = _mixed(spark, d)
    return prepare.Preprocessor.fit(rows, "enrolid", {"categorical": ["region"], "numeric": ["income"], "binary": ["odd"]}).transform(rows)


@query(
    """SELECT enrolid, (least(greatest(l, e[1]), e[2]) - m[2]) / greatest(m[3] - m[1], 1e-10) AS netpay FROM w1, w2, w3""",
    (s.CLAIMS_SQL, "w1 AS (SELECT enrolid, log10(1 + greatest(netpay, 0)) AS l FROM claims WHERE year(svcdate) = 1997)", "w2 AS (SELECT quantile_cont(l, [0.02, 0.975]) AS e FROM w1)", "w3 AS (SELECT quantile_cont(least(greatest(l, e[1]), e[2]), [0.25, 0.5, 0.75]) AS m FROM w1, w2)"),
    "netpay:6",
)
def warp_log_clip(spark, d):
    rows = _base(spark, d).select("enrolid", "netpay")
    return prepare.warp_log_clip(rows, ["netpay"], rows)


@query("SELECT event_id, least(greatest(cume_dist() OVER (ORDER BY score), 0.025), 0.975) - 0.5 AS score FROM scored", (s.SCORED_SQL,), "score:9")
def warp_rank(spark, d):
    return prepare.warp_rank(s.scored(spark, d).select("event_id", "score"), "score")


@query(
    """SELECT enrolid, dx2, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY enrolid)) AS w FROM (SELECT enrolid, dx2, CAST(count(*) AS DOUBLE) AS tf FROM claims GROUP BY 1, 2) JOIN
    (SELECT dx2, ln((n + 1.0) / (count(DISTINCT enrolid) + 1)) + 1 AS idf FROM claims, (SELECT count(DISTINCT enrolid) AS n FROM claims) GROUP BY dx2, n) USING (dx2)""",
    (s.CLAIMS_SQL,),
    "w:6",
)
def tfidf(spark, d):
    return prepare.tfidf(s.claims(spark, d), "enrolid", "dx2")


@query()
def svd_embedding(spark, d):
    return prepare.truncated_svd(s.vectors(spark, d), "vec_id", 8)


# -- distances ------------------------------------------------------------------------------------

PAIR = "pairs AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.v AS va, b.v AS vb, {0} AS dist FROM vectors a, vectors b WHERE a.target = 0 AND b.target = 1)"
SQL_METRICS = {
    "euclidean": "sqrt(list_sum([(x[1] - x[2]) ** 2 FOR x IN list_zip(a.v, b.v)]))",
    "manhattan": "list_sum([abs(x[1] - x[2]) FOR x IN list_zip(a.v, b.v)])",
    "chebyshev": "list_max([abs(x[1] - x[2]) FOR x IN list_zip(a.v, b.v)])",
    "cosine": "1 - list_cosine_similarity(a.v, b.v)",
    "jaccard": "list_sum([CAST((x[1] > 0) != (x[2] > 0) AS INT) FOR x IN list_zip(a.v, b.v)]) / list_sum([CAST(x[1] > 0 OR x[2] > 0 AS INT) FOR x IN list_zip(a.v, b.v)])",
    "hamming": "list_sum([CAST((x[1] > 0) != (x[2] > 0) AS INT) FOR x IN list_zip(a.v, b.v)]) / len(a.v)",
    "gower": "list_sum([abs(x[1] - x[2]) FOR x IN list_zip(a.v, b.v)]) / len(a.v)",
}


def _split(spark, d, binary=False):
    v = s.vectors(spark, d)
    if binary:
        v = v.withColumn("v", F.transform("v", lambda x: (x > 0).cast("double")))
    return v.where("target = 0"), v.where("target = 1")


def _register_distances():
    for metric, sql in SQL_METRICS.items():

        def run(spark, d, metric=metric):
            controls, cases = _split(spark, d, metric in ("jaccard", "hamming"))
            return distance.pairwise(controls, cases, metric)

        run.__name__ = f"pairwise_{metric}"
        query("SELECT a_id, b_id, dist FROM pairs", (s.VECTORS_SQL, PAIR.format(sql)), "dist:6")(run)


_register_distances()
EUCLID = PAIR.format(SQL_METRICS["euclidean"])


@query("SELECT a_id, b_id, dist, rank FROM (SELECT b_id AS a_id, a_id AS b_id, dist, row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) AS rank FROM pairs) WHERE rank <= 5", (s.VECTORS_SQL, EUCLID), "dist:6")
def nearest_controls(spark, d):
    controls, cases = _split(spark, d)
    return distance.nearest(cases, controls, 5)


@query("SELECT a_id, b_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) AS k FROM pairs) WHERE k <= 3", (s.VECTORS_SQL, EUCLID), "dist:6")
def cheapest_edges(spark, d):
    return curate.cheapest_edges(*_split(spark, d), 3)


@query(
    "SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_unique, (SELECT sum(n) FROM (SELECT n FROM t ORDER BY n DESC, dist LIMIT 5)) / sum(n) AS top5_mass, count(*) < 200 OR (SELECT sum(n) FROM (SELECT n FROM t ORDER BY n DESC, dist LIMIT 5)) / sum(n) > 0.05 AS degenerate FROM t",
    (s.VECTORS_SQL, PAIR.format(SQL_METRICS["hamming"]), "t AS (SELECT round(dist, 6) AS dist, count(*) AS n FROM pairs GROUP BY 1)"),
    "top5_mass:9",
)
def tie_diagnostics(spark, d):
    controls, cases = _split(spark, d, True)
    return distance.tie_diagnostics(distance.pairwise(controls, cases, "hamming").withColumn("dist", F.round("dist", 6)))


@query(
    "SELECT CAST(i - 1 AS INT) AS feature, avg(abs(a.v[i] - b.v[i])) AS mean_gap, quantile_cont(abs(a.v[i] - b.v[i]), 0.5) AS median_gap FROM vectors a JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM vectors WHERE target = 1) b ON a.vec_id % b.n = b.place, range(1, 65) t(i) WHERE a.target = 0 GROUP BY i",
    (s.VECTORS_SQL,),
    "mean_gap:6 median_gap:6",
)
def feature_contributions(spark, d):
    return distance.feature_contributions(distance.sampled_gaps(*_split(spark, d)))


@query("SELECT count(DISTINCT vec_id) AS n_ids, true AS square, 0.0::DOUBLE AS diagonal, 0.0::DOUBLE AS asymmetry FROM vectors WHERE target = 1", (s.VECTORS_SQL,), "diagonal:6 asymmetry:6")
def alignment(spark, d):
    _, cases = _split(spark, d)
    return distance.alignment(distance.pairwise(cases, cases, "manhattan"))


# -- curation -------------------------------------------------------------------------------------


@query("SELECT a_id AS seed_id FROM pairs GROUP BY a_id ORDER BY avg(dist), a_id LIMIT 1", (s.VECTORS_SQL, EUCLID))
def seed_smart(spark, d):
    return spark.createDataFrame([(curate.seed_smart(*_split(spark, d)),)], "seed_id bigint")


@query(
    "SELECT vec_id AS seed_id FROM vectors, (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS m FROM vectors, range(1, 65) t(i) WHERE target = 0 GROUP BY i)) WHERE target = 0 ORDER BY list_sum([(x[1] - x[2]) ** 2 FOR x IN list_zip(v, c)]), vec_id LIMIT 1",
    (s.VECTORS_SQL,),
)
def seed_centroid(spark, d):
    return spark.createDataFrame([(curate.seed_centroid(_split(spark, d)[0], "vec_id"),)], "seed_id bigint")


@query()
def seed_density(spark, d):
    return spark.createDataFrame([(curate.seed_density(_split(spark, d)[0]),)], "seed_id bigint")


@query()
def seed_random(spark, d):
    return spark.createDataFrame([(curate.seed_random(_split(spark, d)[0], "vec_id", 7),)], "seed_id bigint")


@query("SELECT b_id, w / avg(w) OVER () AS weight FROM (SELECT b_id, 1 / (min(dist) + 1e-8) AS w FROM pairs GROUP BY b_id)", (s.VECTORS_SQL, EUCLID), "weight:6")
def boundary_weights(spark, d):
    return curate.boundary_weights(*_split(spark, d))


@query(
    "SELECT b_id, w / avg(w) OVER () AS weight FROM (SELECT b_id, 1 / (count(*) FILTER (dist < eps) + 1.0) AS w FROM cc, (SELECT quantile_cont(dist, 0.1) AS eps FROM cc) GROUP BY b_id)",
    (s.VECTORS_SQL, "cc AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_sum([abs(x[1] - x[2]) FOR x IN list_zip(a.v, b.v)]) AS dist FROM vectors a, vectors b WHERE a.target = 1 AND b.target = 1 AND a.vec_id != b.vec_id)"),
    "weight:6",
)
def density_weights(spark, d):
    return curate.density_weights(_split(spark, d)[1], metric="manhattan")


@query("SELECT b_id, min(dist) AS least FROM pairs GROUP BY b_id ORDER BY least, b_id LIMIT 10", (s.VECTORS_SQL, EUCLID), "least:6")
def hardest_cases(spark, d):
    return curate.hardest_cases(*_split(spark, d), 10)


@query()
def farthest_first(spark, d):
    controls, _ = _split(spark, d)
    return curate.dispersed(controls, 60, curate.seed_centroid(controls, "vec_id"))


@query()
def d2_selection(spark, d):
    controls, _ = _split(spark, d)
    return curate.dispersed(controls, 60, curate.seed_centroid(controls, "vec_id"), how="d2", random_state=3)


@query()
def adaptive_pool(spark, d):
    controls, cases = _split(spark, d)
    return curate.adaptive_pool(controls, cases, None, curate.seed_centroid(controls, "vec_id"))


@query()
def dispersed_by_leaf(spark, d):
    v = s.vectors(spark, d).withColumn("leaf", F.col("label") % 3)
    return curate.dispersed_by_leaf(v.withColumn("target", (F.col("vec_id") % 9 == 0).cast("int")), "leaf", 2, 40)


@query()
def sparse_matching(spark, d):
    return curate.matched_vectors(*_split(spark, d), cheapest=3)


@query()
def min_cost_matching(spark, d):
    return curate.matched_vectors(*_split(spark, d))


@query()
def min_cost_matching_1_to_2(spark, d):
    return curate.matched_vectors(*_split(spark, d), ratio=2)


@query()
def two_stage_curation(spark, d):
    return curate.two_stage(s.vectors(spark, d), 2 * _split(spark, d)[1].count(), weighting="boundary")[1]


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY sha256('11:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place FROM vectors WHERE target = 0 ORDER BY place LIMIT 100", (s.VECTORS_SQL,))
def random_controls(spark, d):
    return curate.random_ids(_split(spark, d)[0], 100, "vec_id", 11)


@query("SELECT vec_id, target FROM (SELECT vec_id, target, row_number() OVER (PARTITION BY target ORDER BY sha256('5:' || CAST(vec_id AS VARCHAR)), vec_id) AS r FROM vectors) WHERE r <= CASE target WHEN 0 THEN 70 ELSE 30 END", (s.VECTORS_SQL,))
def undersample_to_sizes(spark, d):
    return curate.undersample_to(s.vectors(spark, d).select("vec_id", "target"), "target", {0: 70, 1: 30}, "vec_id", 5)


@query("SELECT vec_id, target FROM (SELECT vec_id, target, row_number() OVER (PARTITION BY target ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), vec_id) AS r FROM vectors) WHERE r <= (SELECT sum(target) FROM vectors)", (s.VECTORS_SQL,))
def random_undersampled(spark, d):
    return resample.random_undersampled(s.vectors(spark, d).select("vec_id", "target"), "target", "vec_id", 2)


@query()
def experiment_recipe(spark, d):
    controls, cases = _split(spark, d)
    matched_ids = curate.matched_vectors(controls, cases).select(F.col("control_id").alias("id"))
    return curate.recipe("matched_1N+random_2N", cases, controls, matched_ids, matched_ids, "vec_id", 3)


@query("SELECT avg(dist) AS mean_cost, quantile_cont(dist, 0.5) AS q50, quantile_cont(dist, 0.9) AS q90, count(*) AS n FROM pairs", (s.VECTORS_SQL, EUCLID), "mean_cost:6 q50:6 q90:6")
def cost_summary(spark, d):
    return curate.distance_summary(*_split(spark, d))


# -- resampling -----------------------------------------------------------------------------------

NEAR = "near AS (SELECT a_id, b_id, dist, row_number() OVER (PARTITION BY a_id ORDER BY dist, b_id) AS k FROM pairs)"


@query("SELECT a_id AS id FROM near WHERE k <= 3 GROUP BY a_id ORDER BY avg(dist), a_id LIMIT (SELECT sum(target) FROM vectors)", (s.VECTORS_SQL, EUCLID, NEAR))
def near_miss_1(spark, d):
    return resample.near_miss(s.vectors(spark, d), 1)


@query("SELECT a_id AS id FROM (SELECT a_id, dist, row_number() OVER (PARTITION BY a_id ORDER BY dist DESC, b_id) AS k FROM pairs) WHERE k <= 3 GROUP BY a_id ORDER BY avg(dist), a_id LIMIT (SELECT sum(target) FROM vectors)", (s.VECTORS_SQL, EUCLID))
def near_miss_2(spark, d):
    return resample.near_miss(s.vectors(spark, d), 2)


@query(
    "SELECT a_id AS id FROM near WHERE k <= 3 AND a_id IN (SELECT a_id FROM (SELECT a_id, row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) AS r FROM pairs) WHERE r <= 3) GROUP BY a_id ORDER BY avg(dist) DESC, a_id LIMIT (SELECT sum(target) FROM vectors)",
    (s.VECTORS_SQL, EUCLID, NEAR),
)
def near_miss_3(spark, d):
    return resample.near_miss(s.vectors(spark, d), 3)


ALL_NEAR = "alln AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.target AS ya, b.target AS yb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum([abs(x[1] - x[2]) FOR x IN list_zip(a.v, b.v)]), b.vec_id) AS k FROM vectors a, vectors b WHERE a.vec_id != b.vec_id)"


@query(
    "SELECT x.a_id AS id FROM one x JOIN one y ON x.a_id = y.b_id AND x.b_id = y.a_id WHERE x.ya = 0 AND x.yb = 1",
    (s.VECTORS_SQL, ALL_NEAR, "one AS MATERIALIZED (SELECT a_id, b_id, ya, yb FROM alln WHERE k = 1)"),
)
def tomek_links(spark, d):
    return resample.tomek_links(s.vectors(spark, d), metric="manhattan")


@query("SELECT a_id AS id FROM alln WHERE k <= 3 AND ya = 0 GROUP BY a_id HAVING max(yb) = 1", (s.VECTORS_SQL, ALL_NEAR))
def edited_neighbours(spark, d):
    return resample.edited_out(s.vectors(spark, d), metric="manhattan")


@query(
    "SELECT a_id AS id FROM alln WHERE k <= 3 AND ya = 0 GROUP BY a_id HAVING 2 * sum(yb) > count(*) UNION SELECT b_id FROM alln WHERE k <= 3 AND yb = 0 AND a_id IN (SELECT a_id FROM alln WHERE k <= 3 AND ya = 1 GROUP BY a_id HAVING NOT 2 * sum(yb) > count(*))",
    (s.VECTORS_SQL, ALL_NEAR),
)
def neighbourhood_cleaning(spark, d):
    return resample.cleaned_out(s.vectors(spark, d), metric="manhattan")


@query()
def smote(spark, d):
    return resample.smote(s.vectors(spark, d), 200)


# -- metrics --------------------------------------------------------------------------------------

RUN = """run AS (SELECT *, sum(pos) OVER o AS tp, sum(n - pos) OVER o AS fp, sum(pos) OVER () AS p, sum(n - pos) OVER () AS q, lead(score) OVER o AS lower, lag(score) OVER o AS higher, lead(pos) OVER o AS np, lead(n - pos) OVER o AS nn
  FROM (SELECT score, count(*) AS n, sum(y) AS pos FROM scored GROUP BY score) WINDOW o AS (ORDER BY score DESC))"""
RUN_LEAF = """run AS (SELECT *, sum(pos) OVER o AS tp, sum(n - pos) OVER o AS fp, sum(pos) OVER (PARTITION BY leaf) AS p, sum(n - pos) OVER (PARTITION BY leaf) AS q
  FROM (SELECT leaf, score, count(*) AS n, sum(y) AS pos FROM scored GROUP BY leaf, score) WINDOW o AS (PARTITION BY leaf ORDER BY score DESC))"""
AUC = "sum(pos * ((q - fp) + (n - pos) / 2.0)) / max(p * q)"


@query(f"SELECT {AUC} AS auc FROM run", (s.SCORED_SQL, RUN), "auc:9")
def roc_auc(spark, d):
    return metrics.roc_auc(s.scored(spark, d))


@query(f"SELECT leaf, {AUC} AS auc FROM run GROUP BY leaf", (s.SCORED_SQL, RUN_LEAF), "auc:9")
def roc_auc_by_leaf(spark, d):
    return metrics.roc_auc(s.scored(spark, d), by=["leaf"])


@query("SELECT sum(pos * tp / (tp + fp)) / max(p) AS average_precision FROM run", (s.SCORED_SQL, RUN), "average_precision:9")
def average_precision(spark, d):
    return metrics.average_precision(s.scored(spark, d))


@query(
    """SELECT threshold, (tp * (q - fp) - fp * (p - tp)) / sqrt((tp + fp) * p * q * (q - fp + p - tp)) AS mcc, tp / p AS recall, 1 - fp / q AS specificity FROM
    (SELECT coalesce((score + lower) / 2, score - 1e-12) AS threshold, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q FROM run WHERE lower IS NOT NULL) ORDER BY mcc DESC, threshold LIMIT 1""",
    (s.SCORED_SQL, RUN),
    "threshold:6 mcc:9 recall:9 specificity:9",
)
def best_mcc(spark, d):
    return metrics.best_mcc(s.scored(spark, d))


ROC = "roc AS (SELECT score AS threshold, CAST(tp AS DOUBLE) / p AS recall, 1 - CAST(fp AS DOUBLE) / q AS specificity FROM run WHERE {0})"
COLLINEAR = "higher IS NULL OR lower IS NULL OR np != pos OR nn != n - pos"


@query("SELECT threshold, sqrt(recall * specificity) AS value, recall, specificity FROM roc ORDER BY round(value, 12) DESC, threshold DESC LIMIT 1", (s.SCORED_SQL, RUN, ROC.format(COLLINEAR)), "value:9 recall:9 specificity:9")
def best_gmean(spark, d):
    return metrics.best_balanced(s.scored(spark, d))


@query("SELECT threshold, least(recall, specificity) AS value, recall, specificity FROM roc ORDER BY round(value, 12) DESC, threshold DESC LIMIT 1", (s.SCORED_SQL, RUN, ROC.format(COLLINEAR)), "value:9 recall:9 specificity:9")
def best_min_side(spark, d):
    return metrics.best_balanced(s.scored(spark, d), side="min")


@query("SELECT threshold, recall, specificity FROM roc WHERE specificity >= 0.6 ORDER BY recall DESC, threshold DESC LIMIT 1", (s.SCORED_SQL, RUN, ROC.format("true")), "recall:9 specificity:9")
def recall_at_specificity(spark, d):
    return metrics.recall_at_specificity(s.scored(spark, d), 0.6)


@query("SELECT score AS threshold, 2 * pr * rc / (pr + rc + 1e-10) AS f1, pr AS precision, rc AS recall FROM (SELECT score, CAST(tp AS DOUBLE) / (tp + fp) AS pr, CAST(tp AS DOUBLE) / p AS rc FROM run) ORDER BY f1 DESC, threshold LIMIT 1", (s.SCORED_SQL, RUN), "f1:9 precision:9 recall:9")
def best_f1(spark, d):
    return metrics.best_f1(s.scored(spark, d))


@query(
    "SELECT tp, fp, tn, fn, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, tp / (tp + fp) AS precision FROM (SELECT count(*) FILTER (score >= 2 AND y = 1) AS tp, count(*) FILTER (score >= 2 AND y = 0) AS fp, count(*) FILTER (score < 2 AND y = 0) AS tn, count(*) FILTER (score < 2 AND y = 1) AS fn FROM scored)",
    (s.SCORED_SQL,),
    "recall:9 specificity:9 precision:9",
)
def confusion(spark, d):
    return metrics.confusion(s.scored(spark, d), 2.0).select("tp", "fp", "tn", "fn", "recall", "specificity", "precision")


@query()
def evaluation_record(spark, d):
    rows = s.scored(spark, d)
    record = metrics.evaluation(rows.where("leaf_b < 3"), rows.where("leaf_b >= 3"))
    return spark.createDataFrame(sorted((k, None if v is None else float(v)) for k, v in record.items()), "metric string, value double")


@query("SELECT leaf, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, avg(y) AS rate FROM scored GROUP BY leaf", (s.SCORED_SQL,), "rate:9")
def leaf_rates(spark, d):
    return metrics.leaf_rates(s.scored(spark, d))


@query(
    "SELECT event_id, coalesce(rate, (SELECT avg(y) FROM scored WHERE leaf_b < 3)) AS refit_score FROM scored LEFT JOIN (SELECT leaf, avg(y) AS rate FROM scored WHERE leaf_b < 3 GROUP BY leaf) USING (leaf)",
    (s.SCORED_SQL,),
    "refit_score:9",
)
def leaf_refit(spark, d):
    rows = s.scored(spark, d)
    return metrics.refit_scores(rows.where("leaf_b < 3"), rows).select("event_id", "refit_score")


EXCESS = f"g AS (SELECT leaf, sum(n) AS n, max(p) AS pos, max(q) AS neg, {AUC} AS auc FROM run GROUP BY leaf)"


@query("SELECT sum(n * (auc - 0.5)) FILTER (pos >= 10 AND neg >= 10) / sum(n) FILTER (pos >= 10 AND neg >= 10) AS excess, count(*) FILTER (pos >= 10 AND neg >= 10) AS n_leaves, sum(n) FILTER (pos >= 10 AND neg >= 10) / sum(n) AS coverage FROM g", (s.SCORED_SQL, RUN_LEAF, EXCESS), "excess:9 coverage:9")
def weighted_excess_auc(spark, d):
    return metrics.weighted_excess_auc(s.scored(spark, d))


def _excess_of(score: str, leaf: str, name: str, own: str) -> str:
    run = RUN_LEAF.replace("run AS", f"run_{name} AS").replace("SELECT leaf, score, count", f"SELECT {leaf} AS leaf, {score} AS score, count").replace("GROUP BY leaf, score", "GROUP BY 1, 2")
    g = EXCESS.replace("g AS (", f"g_{name} AS (").replace("FROM run ", f"FROM run_{name} ")
    return f"{run}, {g}, {name} AS (SELECT sum(n * (auc - 0.5)) FILTER (pos >= 10 AND neg >= 10) / sum(n) FILTER (pos >= 10 AND neg >= 10) AS excess, sum(n) FILTER (pos >= 10 AND neg >= 10) / sum(n) AS {own} FROM g_{name})"


@query(
    "SELECT a.excess AS a_in_b, a.coverage_b, b.excess AS b_in_a, b.coverage_a, coalesce((a.excess + b.excess) / 2, a.excess, b.excess) AS \"symmetric\", a.excess - b.excess AS gap FROM a, b",
    (s.SCORED_SQL, _excess_of("score", "leaf_b", "a", "coverage_b"), _excess_of("score_b", "leaf", "b", "coverage_a")),
    "a_in_b:9 coverage_b:9 b_in_a:9 coverage_a:9 symmetric:9 gap:9",
)
def symmetric_excess(spark, d):
    return metrics.symmetric_excess(s.scored(spark, d), "score", "leaf", "score_b", "leaf_b")


@query()
def bootstrap_excess(spark, d):
    return metrics.bootstrap_excess(s.scored(spark, d), replicates=200)


@query()
def bootstrap_difference(spark, d):
    return metrics.bootstrap_scores(s.scored(spark, d), ["score", "score_b"], replicates=200)


NEAR_BOTH = f"""nb AS (SELECT a.vec_id AS id, b.target AS m, {SQL_METRICS['euclidean']} AS dist FROM vectors a, vectors b WHERE a.vec_id != b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id, b.target ORDER BY dist, b.vec_id) <= 10),
  hs AS (SELECT id, avg(dist) FILTER (m = 1) AS d_min, avg(dist) FILTER (m = 0) AS d_maj FROM nb GROUP BY id), hm AS (SELECT id, avg(m) AS minority_share FROM (SELECT id, m FROM nb QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, m) <= 10) GROUP BY id),
  hh AS (SELECT id, d_min, d_maj, d_maj / (d_min + 1e-12) AS ratio, d_maj - d_min AS margin, minority_share FROM hs JOIN hm USING (id))"""


@query("SELECT *, 0.33 * ratio / max(ratio) OVER () + 0.33 * margin / max(margin) OVER () + 0.34 * minority_share / max(minority_share) OVER () AS composite FROM hh", (s.VECTORS_SQL, NEAR_BOTH), "d_min:6 d_maj:6 ratio:6 margin:6 minority_share:6 composite:5")
def hardness(spark, d):
    controls, cases = _split(spark, d)
    every = s.vectors(spark, d)
    return metrics.hardness(distance.nearest(every, cases, 10), distance.nearest(every, controls, 10))


@query(
    """SELECT event_id, least(greatest(coalesce(i.v, CASE WHEN lo.s IS NULL THEN hi.v WHEN hi.s IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) * (e.score - lo.s) / (hi.s - lo.s) END), 1e-6), 1 - 1e-6) AS calibrated FROM scored e
    LEFT JOIN iso i ON i.s = e.score ASOF LEFT JOIN iso lo ON lo.s < e.score ASOF LEFT JOIN iso hi ON hi.s > e.score""",
    (
        s.SCORED_SQL,
        "fit AS (SELECT score AS s, count(*) AS n, sum(y) AS p, row_number() OVER (ORDER BY score) AS i FROM scored WHERE leaf_b < 3 GROUP BY score)",
        "spans AS (SELECT a.i AS j, b.i AS k, sum(c.p) / sum(c.n) AS m FROM fit a JOIN fit b ON b.i >= a.i JOIN fit c ON c.i BETWEEN a.i AND b.i GROUP BY 1, 2)",
        "iso AS (SELECT s, max(low) AS v FROM (SELECT f.s, j, min(m) AS low FROM fit f JOIN spans ON j <= f.i AND k >= f.i GROUP BY 1, 2) GROUP BY s)",
    ),
    "calibrated:9",
)
def isotonic_calibration(spark, d):
    rows = s.scored(spark, d)
    return metrics.calibrated(rows.where("leaf_b < 3"), rows).select("event_id", "calibrated")


@query()
def percentile_gate(spark, d):
    rows = s.scored(spark, d).withColumn("gate", F.col("event_id") % 101)
    percent, cut = metrics.best_gate(rows.where("leaf_b < 3"), "gate", "score", "score_b")
    return metrics.gated(rows, "gate", cut, "score", "score_b").select("event_id", F.lit(percent).alias("percent"), "hybrid")


# -- reports --------------------------------------------------------------------------------------

LEAVES = "leaves AS (SELECT enrolid % 7 AS leaf, annual_cost AS cost, CASE WHEN annual_cost >= 200000 THEN 3 WHEN annual_cost >= 100000 THEN 2 WHEN annual_cost >= 50000 THEN 1 ELSE 0 END AS s FROM annual WHERE year = 1997)"


@query(
    """SELECT leaf, n, share_0, share_1, share_2, share_3, mean_cost, median_cost, std_cost, CASE greatest(share_0, share_1, share_2, share_3) WHEN share_0 THEN 0 WHEN share_1 THEN 1 WHEN share_2 THEN 2 ELSE 3 END AS dominant,
    -list_sum([CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END FOR x IN [share_0, share_1, share_2, share_3]]) AS entropy FROM
    (SELECT leaf, count(*) AS n, """ + ", ".join(f"avg(CAST(s = {k} AS INT)) AS share_{k}" for k in range(4)) + ", avg(cost) AS mean_cost, quantile_cont(cost, 0.5) AS median_cost, stddev_pop(cost) AS std_cost FROM leaves GROUP BY leaf)",
    (s.CLAIMS_SQL, ANNUAL, LEAVES),
    "share_0:9 share_1:9 share_2:9 share_3:9 mean_cost:3 median_cost:3 std_cost:2 entropy:6",
)
def leaf_strata(spark, d):
    rows = cohort.annual_costs(s.claims(spark, d), {Y0: 1.0}).select((F.col("enrolid") % 7).alias("leaf"), F.col("annual_cost").alias("cost"))
    return reports.leaf_strata(rows, "leaf", "cost")


@query("SELECT dx1, claim_type, count(*) AS n, avg(netpay) AS netpay_mean, stddev_samp(netpay) AS netpay_std FROM claims GROUP BY ALL", (s.CLAIMS_SQL,), "netpay_mean:4 netpay_std:4")
def experiment_summary(spark, d):
    return reports.summary(s.claims(spark, d), ["dx1", "claim_type"], ["netpay"])


@query("SELECT enrolid, netpay, svcdate, procgrp FROM (SELECT *, row_number() OVER (PARTITION BY enrolid ORDER BY netpay DESC, svcdate DESC, procgrp DESC) AS k FROM claims) WHERE k = 1", (s.CLAIMS_SQL,), "netpay:4")
def best_row_by_key(spark, d):
    return reports.best_rows(s.claims(spark, d).select("enrolid", "netpay", "svcdate", "procgrp"), ["enrolid"], "netpay", ["svcdate", "procgrp"])


@query(
    "SELECT region, avg(income) FILTER (sex = 'BUILDING') AS mean_a, avg(income) FILTER (sex = 'MACHINERY') AS mean_b, avg(income) FILTER (sex = 'BUILDING') - avg(income) FILTER (sex = 'MACHINERY') AS difference FROM enrollment GROUP BY region",
    (s.ENROLLMENT_SQL,),
    "mean_a:4 mean_b:4 difference:4",
)
def method_difference(spark, d):
    return reports.difference_by(s.enrollment(spark, d), "region", "sex", "BUILDING", "MACHINERY", "income")


@query("SELECT enrolid, agegrp FROM enrollment WHERE region != 'ASIA' UNION ALL SELECT enrolid, 99 FROM enrollment WHERE region = 'ASIA'", (s.ENROLLMENT_SQL,))
def upserted_rows(spark, d):
    e = s.enrollment(spark, d)
    return reports.upserted(e.select("enrolid", "agegrp"), e.where("region = 'ASIA'").select("enrolid", F.lit(99).alias("agegrp")), ["enrolid"])


@query("SELECT count(*) AS n_a, count(*) FILTER (enrolid % 3 != 0) AS n_b, count(*) FILTER (enrolid % 3 != 0) AS n_both, count(*) FILTER (enrolid % 3 = 1) AS n_far FROM enrollment", (s.ENROLLMENT_SQL,))
def cache_verification(spark, d):
    e = s.enrollment(spark, d).select("enrolid", F.lit(1.0).alias("x"))
    other = e.where("enrolid % 3 != 0").withColumn("x", F.when(F.col("enrolid") % 3 == 1, 2.0).otherwise(1.0 + 1e-9))
    return reports.closeness(e, other, "enrolid", ["x"])


@query("SELECT dx2, sum(netpay) AS cost, row_number() OVER (ORDER BY sum(netpay) DESC, dx2) AS rank FROM claims GROUP BY dx2", (s.CLAIMS_SQL,), "cost:4")
def ranked_costs(spark, d):
    return reports.ranked(s.claims(spark, d).groupBy("dx2").agg(F.sum("netpay").alias("cost")), "cost", "dx2")


# -- experiments ----------------------------------------------------------------------------------

ROLES = {"binary": ["has_income", "odd"], "categorical": ["region"], "numeric": ["income"]}


@query(
    """SELECT a.enrolid AS a_id, b.enrolid AS b_id, (abs(a.has_income - b.has_income) + abs(a.odd - b.odd) + """
    + " + ".join(f"CAST((a.region = '{r}') != (b.region = '{r}') AS INT)" for r in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    + """ + abs(a.income - b.income) / r) / 7 AS dist FROM mixed a, mixed b, (SELECT max(income) - min(income) AS r FROM mixed) WHERE NOT (a.region = 'ASIA' AND a.sex = 'BUILDING') AND b.region = 'ASIA' AND b.sex = 'BUILDING'""",
    (s.ENROLLMENT_SQL, MIXED),
    "dist:6",
)
def gower_distances(spark, d):
    rows, case = _mixed(spark, d), F.expr("region = 'ASIA' AND sex = 'BUILDING'")
    return experiments.distances_for("gower", rows.where(~case), rows.where(case), rows, ROLES, "enrolid")


@query(
    "SELECT target, auc, average_precision FROM (SELECT 'y' AS target, sum(pos * ((q - fp) + (n - pos) / 2.0)) / max(p * q) AS auc, sum(pos * tp / (tp + fp)) / max(p) AS average_precision FROM run UNION ALL SELECT 'z', sum(pos * ((q - fp) + (n - pos) / 2.0)) / max(p * q), sum(pos * tp / (tp + fp)) / max(p) FROM run_z)",
    (s.SCORED_SQL, RUN, RUN.replace("run AS", "run_z AS").replace("sum(y) AS pos", "sum(1 - y) AS pos")),
    "auc:9 average_precision:9",
)
def reevaluated_targets(spark, d):
    return experiments.reevaluated(s.scored(spark, d).withColumn("z", 1 - F.col("y")), ["y", "z"])


@query(
    f"SELECT (SELECT {AUC} FROM run) AS auc, (SELECT sum(pos * tp / (tp + fp)) / max(p) FROM run) AS average_precision, t AS threshold, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tn / (tn + fp) AS specificity FROM (SELECT 2.0::DOUBLE AS t, count(*) FILTER (score >= 2 AND y = 1) AS tp, count(*) FILTER (score >= 2 AND y = 0) AS fp, count(*) FILTER (score < 2 AND y = 0) AS tn, count(*) FILTER (score < 2 AND y = 1) AS fn FROM scored)",
    (s.SCORED_SQL, RUN),
    "auc:9 average_precision:9 precision:9 recall:9 f1:9 specificity:9",
)
def classifier_report(spark, d):
    return experiments.classifier_report(s.scored(spark, d), threshold=2.0)


@query("SELECT 'asia' AS set, count(*) AS n, avg(income) AS mean, quantile_cont(income, 0.25) AS q25, quantile_cont(income, 0.5) AS median, quantile_cont(income, 0.75) AS q75 FROM enrollment WHERE region = 'ASIA' UNION ALL SELECT 'all', count(*), avg(income), quantile_cont(income, 0.25), quantile_cont(income, 0.5), quantile_cont(income, 0.75) FROM enrollment", (s.ENROLLMENT_SQL,), "mean:4 q25:4 median:4 q75:4")
def cost_sets(spark, d):
    e = s.enrollment(spark, d)
    ids = lambda x: x.select(F.col("enrolid").alias("id"))
    return experiments.cost_sets(e, {"asia": ids(e.where("region = 'ASIA'")), "all": ids(e)}, "income", "enrolid")


@query("SELECT CASE WHEN region = 'ASIA' THEN 'asia' ELSE 'rest' END AS set, 'income' AS feature, (income - m) / sd AS value FROM enrollment, (SELECT avg(income) AS m, stddev_pop(income) AS sd FROM enrollment)", (s.ENROLLMENT_SQL,), "value:6")
def scaled_long(spark, d):
    e = s.enrollment(spark, d)
    return experiments.scaled_long({"asia": e.where("region = 'ASIA'"), "rest": e.where("region != 'ASIA'")}, ["income"])


@query(f"SELECT enrolid, quarter(svcdate) AS quarter, max(st) AS max_stage, avg(st) AS mean_stage, count(DISTINCT month(svcdate)) AS months, count(st) AS n_staged, count(*) - count(st) AS n_unstaged FROM (SELECT *, {STAGE} AS st FROM staged) GROUP BY ALL", (s.CLAIMS_SQL, STAGED), "mean_stage:9")
def quarterly_stage(spark, d):
    return experiments.quarterly_stage(_staged(spark, d), "enrolid", "svcdate", fc.disease_stage(["dx1", "dx2"]))


@query("SELECT a_id, avg(dist) AS mean_dist FROM (SELECT b_id AS a_id, dist, row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) AS k FROM pairs) WHERE k <= 3 GROUP BY a_id", (s.VECTORS_SQL, EUCLID), "mean_dist:6")
def nearest_mean(spark, d):
    controls, cases = _split(spark, d)
    return experiments.nearest_mean(distance.nearest(cases, controls, 5), 3)


@query("SELECT dx1 AS class, dx2 AS feature, avg(abs(netpay)) AS mean_abs FROM claims GROUP BY dx1, dx2 QUALIFY row_number() OVER (PARTITION BY dx1 ORDER BY avg(abs(netpay)) DESC, dx2) <= 3", (s.CLAIMS_SQL,), "mean_abs:4")
def top_features(spark, d):
    return experiments.top_features(s.claims(spark, d).select(F.col("dx1").alias("class"), F.col("dx2").alias("feature"), F.col("netpay").alias("value")), 3)


@query("SELECT enrolid, income, coalesce(y, 0) AS y FROM enrollment LEFT JOIN (SELECT DISTINCT enrolid, 1 AS y FROM claims WHERE year(svcdate) = 1997) USING (enrolid)", (s.CLAIMS_SQL, s.ENROLLMENT_SQL))
def refreshed_labels(spark, d):
    e = s.enrollment(spark, d).select("enrolid", "income", F.lit(7).alias("y"))
    return experiments.refreshed(e, _base(spark, d).select("enrolid", F.lit(1).alias("y")).distinct(), "enrolid")


@query()
def curated_sample(spark, d):
    return experiments.curated(s.vectors(spark, d), seed_method="centroid")["controls"]


@query()
def pool_sweep(spark, d):
    n = _split(spark, d)[1].count()
    return experiments.pool_sweep(s.vectors(spark, d), [n, 2 * n, 3 * n])


@query()
def feature_set_ablation(spark, d):
    v = s.vectors(spark, d)
    return experiments.ablation({"front": v.withColumn("v", F.slice("v", 1, 16)), "back": v.withColumn("v", F.slice("v", 17, 48))}, 2 * _split(spark, d)[1].count())


@query(
    "SELECT CAST(r AS DOUBLE) AS ratio, vec_id AS id FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), vec_id) AS k FROM vectors WHERE target = 0), (SELECT unnest([0.5, 1.0, 2.0]) AS r), (SELECT sum(target) AS n FROM vectors) WHERE k <= ceil(r * n)",
    (s.VECTORS_SQL,),
)
def ratio_sweep(spark, d):
    controls, cases = _split(spark, d)
    return experiments.ratio_sweep(cases, controls, [0.5, 1, 2], lambda c, n: curate.random_ids(c, n, "vec_id", 1), "vec_id")


@query()
def phenotype_features(spark, d):
    df = cohort_feature_table(spark, d)
    out, columns = names.phenotype_features(df, [c for c in df.columns if c.startswith("has_")], names.PRESETS[1], "1998")
    return out.select("enrolid", *columns)


# -- extras ---------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", (), "total:4")
def event_windows(spark, d):
    out = stream.windowed_counts(s.table(spark, d, "events"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


from . import more_queries  # noqa: E402, F401  (registers the rest)
