"""Registered queries of the operators that stand alone: sources and sinks, name and schema rules, joins, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as fc
from ..functions import names
from ..operators import cohort, curate, distance, experiments, metrics, models, prepare, profile, reports
from ..sources import readers, writers
from . import queries as q
from . import standins as s
from .features import MEASURES
from .registry import query


def _rows(values: str, columns: str) -> str:
    return f"SELECT * FROM (VALUES {values}) t({columns})"


# -- sources and sinks ----------------------------------------------------------------------------

ENROLLED = "SELECT enrolid, region, agegrp FROM enrollment"


def _few(spark, d):
    return s.enrollment(spark, d).select("enrolid", "region", "agegrp", "income")


@query(ENROLLED, (s.ENROLLMENT_SQL,))
def csv_projected(spark, d):
    path = writers.scratch(spark, "enrolled") + ".csv"
    _few(spark, d).write.option("header", True).csv(path)
    return readers.read_any(spark, path, schema="enrolid bigint, region string, agegrp int, income double", columns=["enrolid", "region", "agegrp"])


@query(ENROLLED + " UNION ALL " + ENROLLED, (s.ENROLLMENT_SQL,))
def csv_appended(spark, d):
    path = writers.scratch(spark, "enrolled")
    for _ in range(2):
        writers.append_csv(_few(spark, d), path)
    return readers.read_csv(spark, path, "enrolid bigint, region string, agegrp int, income double", ["enrolid", "region", "agegrp"])


@query("SELECT enrolid, region, agegrp, CASE WHEN enrolid % 2 = 0 THEN income END AS income FROM enrollment", (s.ENROLLMENT_SQL,), "income:4")
def parts_united(spark, d):
    base, df = writers.scratch(spark, "parts"), _few(spark, d)
    writers.write_parquet(df.where("enrolid % 2 = 0"), f"{base}/part_0.parquet")
    writers.write_parquet(df.where("enrolid % 2 = 1").drop("income"), f"{base}/part_1.parquet")
    return readers.read_parts(spark, f"{base}/part_*.parquet").select("enrolid", "region", "agegrp", "income")


@query(ENROLLED + " WHERE region = 'ASIA'", (s.ENROLLMENT_SQL,))
def partitioned_sink(spark, d):
    path = writers.scratch(spark, "by_region")
    writers.write_parquet(_few(spark, d), path, ("region",))
    return readers.read_any(spark, path).where("region = 'ASIA'").select("enrolid", "region", "agegrp")


@query("SELECT enrolid, CASE WHEN agegrp = 0 THEN 100 ELSE agegrp END AS agegrp FROM enrollment", (s.ENROLLMENT_SQL,))
def upserted_sink(spark, d):
    path, df = writers.scratch(spark, "summary"), _few(spark, d).select("enrolid", "agegrp")
    writers.upsert(spark, df, path, ("enrolid",))
    writers.upsert(spark, df.where("agegrp = 0").withColumn("agegrp", F.lit(100)), path, ("enrolid",))
    return spark.read.parquet(path)


@query("SELECT vec_id AS a_id, b AS b_id, CAST(CAST(d AS FLOAT) AS DOUBLE) AS dist FROM (SELECT a.vec_id, b.vec_id AS b, " + q.SQL_METRICS["manhattan"] + " AS d FROM vectors a, vectors b WHERE a.target = 0 AND b.target = 1) WHERE vec_id % 5 = 0 AND b % 2 = 0", (s.VECTORS_SQL,), "dist:4")
def distance_rows_stored(spark, d):
    controls, cases = q._split(spark, d)
    path = writers.scratch(spark, "rows")
    writers.write_distances(distance.distance_rows(controls, cases, "manhattan"), path)
    wanted = lambda df, n: df.where(F.col("vec_id") % n == 0).select(F.col("vec_id").alias("id"))
    rows = readers.read_submatrix(spark.read.parquet(path).withColumnRenamed("id", "a_id"), wanted(controls, 5))
    pairs = rows.select("a_id", F.explode(F.arrays_zip("others", "dist")).alias("x")).select("a_id", F.col("x.others").alias("b_id"), F.col("x.dist").cast("double").alias("dist"))
    return readers.read_submatrix(pairs, None, wanted(cases, 2))


@query(_rows("('metrics', 'auc', 0.5), ('metrics', 'n', 3.0), ('missing', 'n', 0.0)", "document, name, value").replace("0.5)", "0.5::DOUBLE)"), r="value:4")
def json_documents(spark, d):
    path = writers.scratch(spark, "metrics") + ".json"
    writers.write_json_document(spark, {"auc": 0.5, "n": 3}, path)
    found = [("metrics", k, float(v)) for k, v in readers.read_json_document(spark, path).items()]
    missing = readers.read_json_document(spark, path + ".none", {"n": 0})
    return spark.createDataFrame(found + [("missing", k, float(v)) for k, v in missing.items()], "document string, name string, value double")


@query(_rows("('cohort', 'a'), ('features', 'a_features_with_meds.parquet'), ('undersampled', 'undersampled_1.csv'), ('undersampled', 'undersampled_2.csv')", "what, name"))
def files_found(spark, d):
    base, one = writers.scratch(spark, "study"), spark.range(1)
    for name in ("a_claims.parquet", "a_enrollment.parquet", "b_claims.parquet", "a_features.parquet", "a_features_with_meds.parquet"):
        one.write.parquet(f"{base}/{name}")
    for n in (1, 2):
        one.write.csv(f"{base}/undersampled_{n}.csv")
    name = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    rows = [("cohort", c) for c in readers.cohorts(spark, base)] + [("features", name(readers.feature_file(spark, base, "a")))]
    return spark.createDataFrame(rows + [("undersampled", name(p)) for p in readers.undersampled_files(spark, base)], "what string, name string")


@query(_rows("('euclid', '1', 'm/run_euclid_s1.csv'), ('gower', '12', 'run_gower_s12.csv')", "metric, seed, path"))
def runs_found(spark, d):
    found = readers.runs(["m/run_euclid_s1.csv", "run_gower_s12.csv", "other.csv"], r"run_(?P<metric>\w+)_s(?P<seed>\d+)")
    return spark.createDataFrame([(r["metric"], r["seed"], r["path"]) for r in found], "metric string, seed string, path string")


@query("SELECT unnest([1, 2, 5, 6, 7]) AS seed")
def seeds_listed(spark, d):
    return spark.createDataFrame([(n,) for n in readers.seeds("1,2,5-7")], "seed int")


@query(_rows("('x/metric=gower/kind=pn'), ('x/metric=gower/kind=nn/seed=3/leaf=7')", "path"))
def distance_paths(spark, d):
    return spark.createDataFrame([(writers.distance_path("x/", "gower", "pn"),), (writers.distance_path("x", "gower", "nn", 3, "7"),)], "path string")


@query("SELECT region, count(*) AS n FROM enrollment JOIN claims USING (enrolid) GROUP BY region", (s.CLAIMS_SQL, s.ENROLLMENT_SQL))
def joined_views(spark, d):
    writers.views(spark, v_claims=s.claims(spark, d), v_enrollment=s.enrollment(spark, d))
    return spark.sql("SELECT region, count(*) AS n FROM v_enrollment JOIN v_claims USING (enrolid) GROUP BY region")


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY sha256('4:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place FROM vectors ORDER BY place LIMIT 20", (s.VECTORS_SQL,))
def remembered_sample(spark, d):
    path = writers.scratch(spark, "ids")
    made = [writers.remembered(spark, path, lambda seed=seed: curate.random_ids(s.vectors(spark, d), 20, "vec_id", seed)) for seed in (4, 5)]
    return made[1]  # the second call reads what the first has made


# -- predicates, schema and name rules -----------------------------------------------------------


@query("SELECT enrolid, count(*) AS n FROM claims WHERE dx1 LIKE 'PRO%' OR dx2 LIKE 'PRO%' OR dx1 LIKE 'ECO%' OR dx2 LIKE 'ECO%' GROUP BY enrolid", (s.CLAIMS_SQL,))
def prefix_claims(spark, d):
    return s.claims(spark, d).where(fc.prefix_in_any(["dx1", "dx2"], ["PRO", "ECO"], True)).groupBy("enrolid").agg(F.count("*").alias("n"))


@query(_rows("('dx1', 'diagnosis'), ('dx2', 'diagnosis'), ('pdx', 'diagnosis'), ('NETPAY', 'cost')", "name, kind"))
def schema_picks(spark, d):
    df = s.claims(spark, d).withColumnRenamed("netpay", "NETPAY")
    return spark.createDataFrame([(c, "diagnosis") for c in fc.diagnosis_columns(df)] + [(fc.cost_column(df), "cost")], "name string, kind string")


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders GROUP BY 1")
def dates_coerced(spark, d):
    text = s.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return fc.as_date(text, "day").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(_rows("('a_b', 1), ('a_b_2', 2), ('c_1', 3), ('x', 4)", "name, place"))
def safe_names(spark, d):
    df = fc.renamed(spark.createDataFrame([], "`a b` int, `a-b` int, `c(1)` int, `_x_` int"))
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(df.columns)], "name string, place int")


@query("SELECT l_orderkey, l_linenumber, TRY_CAST(l_comment_number AS DOUBLE) AS x FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'none' ELSE CAST(l_quantity AS VARCHAR) END AS l_comment_number FROM lineitem)")
def numbers_coerced(spark, d):
    x = F.when(F.col("l_linenumber") % 3 == 0, "none").otherwise(F.col("l_quantity").cast("string")).alias("number")
    return readers.aliased(readers.coerced(s.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x), ["number"]), {"number": "x", "other": "y"})


@query("SELECT enrolid, ln(1 + greatest(coalesce(netpay - 20000, 0), 0)) AS amount_log FROM claims", (s.CLAIMS_SQL,), "amount_log:9")
def log_amounts(spark, d):
    return s.claims(spark, d).select("enrolid", fc.log_amount(F.col("netpay") - 20000).alias("amount_log"))


@query("SELECT dx2 AS raw, upper(replace(trim(dx2), '.', '')) AS code, count(*) AS n FROM claims GROUP BY 1, 2", (s.CLAIMS_SQL,))
def normalised_codes(spark, d):
    df = s.claims(spark, d).withColumn("raw", F.col("dx2"))
    return cohort.normalized(df.withColumn("code", F.concat(F.lit(" "), "dx2")), ["code"]).groupBy("raw", "code").agg(F.count("*").alias("n"))


NAMED = {"med_has_x": "medications", "has_procgrp_1": "procedures", "has_cond_E11": "diagnosis_flags", "2017Q1_cost": "cost_features", "total_claims": "utilization", "SEX": "demographics", "essex": "other"}


@query(_rows(", ".join(f"('{a}', '{b}')" for a, b in NAMED.items()), "name, \"group\""))
def name_groups(spark, d):
    return spark.createDataFrame([(c, g) for g, cs in names.grouped_names(list(NAMED)).items() for c in cs], "name string, group string")


READABLE = {
    "static_lead_Ibpm": "Lead I: Heart Rate (bpm)",
    "static_lead_aVLhdist_pr_med": "Lead aVL: PR Interval Distance - Median",
    "tsfresh_dim_0__fourier_entropy__bins_10_leadV3": "Lead V3: Fourier Entropy Bins 10 (Time Series)",
    "ICD_25000": "ICD-9: 250.00",
    "Medication__12": "Medication: Aspirin (Code: 12)",
    "age_group": "Age Group",
}


@query(_rows(", ".join(f"('{b}')" for b in READABLE.values()), "name"))
def readable_names(spark, d):
    df = names.translated(spark.createDataFrame([], ", ".join(f"`{c}` int" for c in READABLE)), {c: names.readable(c, None, {"12": "Aspirin"}) for c in READABLE})
    return spark.createDataFrame([(c,) for c in df.columns], "name string")


COLUMNS = ["enrolid", "has_Dorsopathies", "has_Obesity", "has_cost_increasing", "total_claims_2017", "cost_2017", "cost_2018", "AGEGRP"]


@query(_rows("('flags', 'has_Dorsopathies'), ('flags', 'has_Obesity'), ('match', 'AGEGRP'), ('match', 'total_claims_2017'), ('match', 'cost_2017'), ('medical', 'AGEGRP'), ('medical', 'enrolid')", "what, name"))
def feature_sets(spark, d):
    flags = [c for c in COLUMNS if c.startswith("has_")]
    sets = {"flags": names.phenotype_names(COLUMNS, flags), "match": names.matching_names(COLUMNS, ["AGEGRP"], flags), "medical": profile.feature_set(["AGEGRP", "cost_2017", "enrolid"], "medical_only")}
    return spark.createDataFrame([(k, c) for k, cs in sets.items() for c in cs], "what string, name string")


@query("SELECT enrolid, CAST(annual_cost_1998 >= (SELECT quantile_cont(annual_cost_1998, 0.98) FROM wide) AS INT) AS top_2_pct_cost_1998 FROM wide", (s.CLAIMS_SQL, q.ANNUAL, q.WIDE2))
def target_picked(spark, d):
    df, target, _ = names.target_and_features(q._wide(spark, d, s.OUTCOME), [s.OUTCOME], cost=lambda y: f"annual_cost_{y}")
    return df.select("enrolid", target)


@query("SELECT enrolid, CAST(income <= 0 AS INT) AS loss FROM enrollment", (s.ENROLLMENT_SQL,))
def binary_targets(spark, d):
    return profile.binary_target(s.enrollment(spark, d).select("enrolid", F.when(F.col("income") > 0, 7).otherwise(3).alias("loss")), "loss")


@query(_rows("('region', 'categorical'), ('sex', 'categorical'), ('agegrp', 'categorical'), ('has_income', 'categorical'), ('odd', 'categorical'), ('income', 'numeric')", "name, kind"))
def cardinality_roles(spark, d):
    return spark.createDataFrame([(c, k) for k, cs in profile.roles_by_cardinality(q._mixed(spark, d), "enrolid").items() for c in cs], "name string, kind string")


# -- the feature table, cell by cell ---------------------------------------------------------------


def _cells_sql() -> str:
    parts = ["SELECT enrolid, 'annual_cost_1997' AS feature, annual_cost_1997 AS value FROM wide", "SELECT enrolid, 'annual_cost_1998', annual_cost_1998 FROM wide", "SELECT w.enrolid, 'agegrp', coalesce(e.agegrp, 0) FROM wide w LEFT JOIN enrollment e USING (enrolid)"]
    parts += [f"SELECT enrolid, 'top_{n}_pct_cost_1998', CAST(annual_cost_1998 >= (SELECT quantile_cont(annual_cost_1998, {p}) FROM wide) AS INT) FROM wide" for n, p in ((10, 0.9), (5, 0.95), (2, 0.98))]
    flagged = "SELECT w.enrolid, f.name, CAST(EXISTS (SELECT 1 FROM {hits} h WHERE h.enrolid = w.enrolid AND h.name = f.name) AS INT) FROM wide w, (SELECT DISTINCT name FROM {flags}) f"
    parts += [flagged.format(hits="dx_hits", flags="dx_flags"), flagged.format(hits="pr_hits", flags="pr_flags"), flagged.format(hits="md_hits", flags="md_hits")]
    for m in MEASURES:
        c = [f'"1997Q{k}_{m}"' for k in (1, 2, 3, 4)]
        rises = " + ".join(f"CAST({b} > {a} AS INT)" for a, b in zip(c, c[1:], strict=False))
        own = {f"{m}_1997": " + ".join(c), f"{m}_total_increasing_1997": rises, f"{m}_consistently_increasing_1997": f"CAST({rises} = 3 AS INT)", f"{m}_consistently_decreasing_1997": f"CAST({rises} = 0 AS INT)", f"{m}_mean_deriv_1997": f"({c[3]} - {c[0]}) / 3"}
        own |= {f"1997Q{k + 1}_{m}": x for k, x in enumerate(c)}
        for k in range(3):
            own |= {f"{m}_deriv_Q{k + 1}_Q{k + 2}_1997": f"{c[k + 1]} - {c[k]}", f"{m}_is_increasing_Q{k + 1}_Q{k + 2}_1997": f"CAST({c[k + 1]} > {c[k]} AS INT)"}
        mean, square = f"(({' + '.join(c)}) / 4)", lambda n, c=c: " + ".join(f"(x.c{k} - x.mean) ** {n}" for k in range(4))
        pre = f"{m}_quarterly"
        own |= {f"{pre}_max_1997": f"greatest({', '.join(c)})", f"{pre}_min_1997": f"least({', '.join(c)})", f"{pre}_range_1997": f"greatest({', '.join(c)}) - least({', '.join(c)})"}
        parts += [f"SELECT enrolid, '{n}', {e} FROM quarters SEMI JOIN wide USING (enrolid)" for n, e in own.items()]
        shape = f"(SELECT *, sqrt(({square(2)}) / 4) AS std FROM (SELECT enrolid, {', '.join(f'{x} AS c{k}' for k, x in enumerate(c))}, {mean} AS mean FROM quarters SEMI JOIN wide USING (enrolid)) x) x"
        parts += [
            f"SELECT enrolid, '{pre}_skewness_1997', CASE WHEN std > 0 THEN ({square(3)}) / 4 / std ** 3 ELSE 0 END FROM {shape}",
            f"SELECT enrolid, '{pre}_kurtosis_1997', CASE WHEN std > 0 THEN ({square(4)}) / 4 / std ** 4 - 3 ELSE 0 END FROM {shape}",
            f"SELECT enrolid, '{pre}_cv_1997', CASE WHEN mean > 0 THEN std / mean ELSE 0 END FROM {shape}",
        ]
    parts += [f"SELECT enrolid, '1997Q{k}_total_claims', \"1997Q{k}_total_claims\" FROM quarters SEMI JOIN wide USING (enrolid)" for k in (1, 2, 3, 4)]
    return "SELECT enrolid, feature, CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join(parts) + ") u"


CELLS = (
    "shorts AS (SELECT enrolid, regexp_matches(code, '^PROMO') AS cond, substr(code, 1, 3) AS short FROM codes WHERE code IS NOT NULL)",
    "dx_flags AS (SELECT cond, short, CASE WHEN cond THEN 'has_cond_' ELSE 'has_comorb_' END || short AS name FROM shorts GROUP BY cond, short QUALIFY row_number() OVER (PARTITION BY cond ORDER BY count(*) DESC, short) <= 5)",
    "dx_hits AS (SELECT DISTINCT enrolid, name FROM shorts JOIN dx_flags USING (cond, short))",
    f"pr_flags AS (SELECT procgrp, 'has_procgrp_' || CAST(procgrp AS VARCHAR) AS name FROM claims WHERE year(svcdate) = 1997 AND coalesce({q.COND_SQL}, false) GROUP BY procgrp ORDER BY count(*) DESC, CAST(procgrp AS VARCHAR) LIMIT 5)",
    "pr_hits AS (SELECT DISTINCT enrolid, name FROM claims JOIN pr_flags USING (procgrp) WHERE year(svcdate) = 1997)",
    "md_hits AS (SELECT DISTINCT enrolid, 'med_has_' || trim(regexp_replace(regexp_replace(g, '[^0-9A-Za-z_]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM used JOIN cls USING (thercls) JOIN one USING (thercls))",
)


@query(_cells_sql(), (s.CLAIMS_SQL, s.ENROLLMENT_SQL, s.REDBOOK_SQL, q.ANNUAL, q.WIDE2, q.CODES, q.MEDS, q.TYPED, q.QUARTERS, *CELLS), "value:3")
def cohort_feature_cells(spark, d):
    df = q.QUERIES["cohort_feature_table"](spark, d)
    return profile.long_form(df, ["enrolid"], [c for c in profile.numeric_columns(df) if c != "enrolid"])


# -- joins, splits, samples -------------------------------------------------------------------------


@query("SELECT event_id, y, leaf, score, score_b FROM scored WHERE event_id % 2 = 0 AND event_id % 3 = 0", (s.SCORED_SQL,), "score:4 score_b:4")
def scores_aligned(spark, d):
    rows = s.scored(spark, d)
    return experiments.aligned(rows.select("event_id", "y", "leaf"), rows.where("event_id % 2 = 0").select("event_id", "score"), rows.where("event_id % 3 = 0").select("event_id", "score_b"), "event_id")


@query("SELECT a.vec_id AS case_id, b.vec_id AS control_id, a.place FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM vectors WHERE target = 1) a JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS place FROM vectors WHERE target = 0) b USING (place)", (s.VECTORS_SQL,))
def aligned_by_place(spark, d):
    controls, cases = q._split(spark, d)
    return experiments.aligned_by_place(cases.select(F.col("vec_id").alias("case_id")), controls.select(F.col("vec_id").alias("control_id")), [F.col("case_id")], [F.desc("control_id")]).select("case_id", "control_id", "place")


@query("SELECT enrolid, region, income FROM enrollment", (s.ENROLLMENT_SQL,), "income:4")
def column_backfilled(spark, d):
    e = s.enrollment(spark, d)
    return experiments.backfilled(experiments.backfilled(e.select("enrolid", "region"), e, "income", "enrolid"), e.withColumn("income", F.lit(0)), "income", "enrolid")


@query("SELECT event_id, split, score FROM (SELECT *, CASE WHEN leaf < 5 THEN 'train' WHEN leaf = 5 THEN 'val' ELSE 'test' END AS split FROM scored) WHERE split != 'train' AND event_id % 2 = 0", (s.SCORED_SQL,), "score:4")
def predictions_of_splits(spark, d):
    split = F.when(F.col("leaf") < 5, "train").when(F.col("leaf") == 5, "val").otherwise("test").alias("split")
    rows = s.scored(spark, d).select("event_id", split, "score")
    return experiments.of_split(rows, rows.where("event_id % 2 = 0"), "event_id")


@query(
    "SELECT coalesce(a.dx2, b.dx2) AS path, a.n AS n_a, b.n AS n_b, CAST(a.n IS NOT NULL AS INT) AS in_a, CAST(b.n IS NOT NULL AS INT) AS in_b FROM (SELECT dx2, count(*) AS n FROM claims WHERE procgrp < 3 GROUP BY 1) a FULL JOIN (SELECT dx2, count(*) AS n FROM claims WHERE procgrp > 47 GROUP BY 1) b USING (dx2)",
    (s.CLAIMS_SQL,),
)
def split_tables_compared(spark, d):
    n = lambda where: s.claims(spark, d).where(where).groupBy(F.col("dx2").alias("path")).agg(F.count("*").alias("n"))
    return reports.split_difference(n("procgrp < 3"), n("procgrp > 47"))


@query("SELECT * FROM claims WHERE year(svcdate) = 1997 AND procgrp = 7", (s.CLAIMS_SQL,), "netpay:4")
def claims_in_order(spark, d):
    return cohort.in_order(q._base(spark, d).where("procgrp = 7"))


LEAF_SIZES = "sizes AS (SELECT leaf, count(*) AS n, -(avg(y) * log2(avg(y)) + (1 - avg(y)) * log2(1 - avg(y))) AS entropy FROM scored GROUP BY leaf)"


@query("SELECT leaf, n, 'largest' AS how FROM (SELECT * FROM sizes ORDER BY n DESC, leaf LIMIT 4) UNION ALL SELECT leaf, n, 'diverse' FROM (SELECT * FROM sizes ORDER BY n DESC, leaf LIMIT 2) UNION ALL SELECT leaf, n, 'diverse' FROM (SELECT * FROM sizes WHERE leaf NOT IN (SELECT leaf FROM sizes ORDER BY n DESC, leaf LIMIT 2) ORDER BY entropy DESC, leaf LIMIT 2)", (s.SCORED_SQL, LEAF_SIZES))
def leaves_selected(spark, d):
    p = F.avg(F.col("y").cast("double"))
    leaves = s.scored(spark, d).groupBy("leaf").agg(F.count("*").alias("n"), (-(p * F.log2(p) + (1 - p) * F.log2(1 - p))).alias("entropy"))
    return reports.selected_leaves(leaves, "leaf", 4).select("leaf", "n", F.lit("largest").alias("how")).unionByName(reports.selected_leaves(leaves, "leaf", 4, "diverse").select("leaf", "n", F.lit("diverse").alias("how")))


@query("SELECT vec_id, target FROM vectors WHERE target = 1 OR vec_id % 4 = 1", (s.VECTORS_SQL,))
def undersampled_rows(spark, d):
    v = s.vectors(spark, d).select("vec_id", "target")
    chosen = v.where("target = 0 AND vec_id % 4 = 1").select(F.col("vec_id").alias("id"))
    return curate.undersampled(v, chosen.unionByName(chosen), "vec_id", "target")


@query(
    "SELECT id, pick_order FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pick_order, 0 AS k FROM vectors WHERE target = 0 ORDER BY vec_id LIMIT 10) UNION ALL (SELECT DISTINCT a_id, NULL::BIGINT FROM near WHERE k = 1 AND a_id NOT IN (SELECT vec_id FROM vectors WHERE target = 0 ORDER BY vec_id LIMIT 10) ORDER BY a_id LIMIT 5)",
    (s.VECTORS_SQL, q.EUCLID, "near AS (SELECT a_id, row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) AS k FROM pairs)"),
)
def nearest_forced(spark, d):
    controls, cases = q._split(spark, d)
    picked = controls.orderBy("vec_id").limit(10).select(F.col("vec_id").alias("id"), (F.row_number().over(q.metrics.Window.orderBy("vec_id")) - 1).cast("bigint").alias("pick_order"))
    return curate.nearest_forced(picked, curate.cheapest_edges(controls, cases, 1), 15)


@query(_rows("('cw_none_pool_100', 'none', '100'), ('cw_none_pool_200', 'none', '200'), ('cw_b_pool_100', 'b', '100'), ('cw_b_pool_200', 'b', '200')", "config, cw, pool"))
def option_grid(spark, d):
    parsed = [(g["config"], curate.parse_config(g["config"], ["cw", "pool"])) for g in curate.grid(cw=["none", "b"], pool=[100, 200])]
    return spark.createDataFrame([(c, p["cw"], p["pool"]) for c, p in parsed], "config string, cw string, pool string")


@query("SELECT event_id, y, score FROM scored WHERE y = 1 OR score >= (SELECT quantile_cont(score, 0.9) FROM scored WHERE y = 0)", (s.SCORED_SQL,), "score:4")
def hard_rows(spark, d):
    return metrics.hard_subset(s.scored(spark, d), 10, "score").select("event_id", "y", "score")


@query("SELECT dx1, n, CASE dx1 WHEN 'SMALL' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END AS place FROM (SELECT split_part(dx1, ' ', 1) AS dx1, count(*) AS n FROM claims GROUP BY 1)", (s.CLAIMS_SQL,))
def methods_in_order(spark, d):
    n = s.claims(spark, d).groupBy(F.split("dx1", " ")[0].alias("dx1")).agg(F.count("*").alias("n"))
    rows = reports.in_order(n, "dx1", ["SMALL", "PROMO"]).collect()
    return spark.createDataFrame([(r["dx1"], r["n"], min(k + 1, 3)) for k, r in enumerate(rows)], "dx1 string, n bigint, place int")


@query("SELECT count(DISTINCT leaf) AS n_leaves FROM scored", (s.SCORED_SQL,))
def leaves_counted(spark, d):
    return models.leaf_count(s.scored(spark, d))


@query(_rows("('overlap', true), ('disjoint', false), ('outside', true), ('leak', true)", "guard, raised"))
def guards(spark, d):
    e = s.enrollment(spark, d).select("enrolid")
    tries = {
        "overlap": lambda: experiments.disjoint(e, e.where("enrolid % 2 = 0"), "enrolid"),
        "disjoint": lambda: experiments.disjoint(e.where("enrolid % 2 = 1"), e.where("enrolid % 2 = 0"), "enrolid"),
        "outside": lambda: experiments.contained(e, e.where("enrolid % 2 = 0"), "enrolid"),
        "leak": lambda: names.without_leakage(["cost_1998"], [1998]),
    }
    rows = []
    for name, run in tries.items():
        try:
            run()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "guard string, raised boolean")


@query("SELECT 'a,b,c' AS a, 'b,c,d' AS b, 0.5::DOUBLE AS jaccard")
def tops_compared(spark, d):
    a, b = ["a", "b", "c"], ["b", "c", "d"]
    return spark.createDataFrame([(",".join(a), ",".join(b), reports.jaccard_of_tops(a, b))], "a string, b string, jaccard double")


@query()
def giant_cohort_sampled(spark, d):
    return cohort.down_sample(q._mixed(spark, d).select("enrolid", "odd"), "odd", 50, 40)


@query("SELECT feature, b / w AS ratio FROM (SELECT i - 1 AS feature, avg(abs(a.v[i] - b.v[i])) AS b FROM vectors a, vectors b, range(1, 65) t(i) WHERE a.target = 0 AND b.target = 1 GROUP BY i) JOIN (SELECT i - 1 AS feature, sum(abs(a.v[i] - b.v[i])) / (count(*) - (SELECT count(*) FROM vectors WHERE target = 0)) AS w FROM vectors a, vectors b, range(1, 65) t(i) WHERE a.target = 0 AND b.target = 0 GROUP BY i) USING (feature)", (s.VECTORS_SQL,), "ratio:5")
def contribution_ratio(spark, d):
    controls, cases = q._split(spark, d)
    return experiments.contribution_ratio(distance.mean_gaps(controls, cases), distance.mean_gaps(controls)).select(F.col("feature").cast("bigint").alias("feature"), "ratio")


# -- models ---------------------------------------------------------------------------------------

FEATURES = [f"x{i}" for i in range(8)]


def _table(spark, d):
    return s.vectors(spark, d).select("vec_id", "target", *(F.get("v", F.lit(i)).alias(f"x{i}") for i in range(8)))


@query("SELECT vec_id, target, n / (2.0 * count(*) OVER (PARTITION BY target)) AS weight FROM vectors, (SELECT count(*) AS n FROM vectors)", (s.VECTORS_SQL,), "weight:9")
def balanced_weights(spark, d):
    return models.balanced(s.vectors(spark, d).select("vec_id", "target"), "target")


@query("SELECT vec_id, CAST(v[1] > (SELECT quantile_cont(v[1], 0.5) FROM vectors) AS INT) AS x0, CAST(v[2] > (SELECT quantile_cont(v[2], 0.5) FROM vectors) AS INT) AS x1 FROM vectors", (s.VECTORS_SQL,))
def median_binarised(spark, d):
    t = _table(spark, d).select("vec_id", "x0", "x1")
    return models.binarised_at_median(t, ["x0", "x1"], t)


@query()
def tree_split_table(spark, d):
    model = models.fit(_table(spark, d), FEATURES, "target", "tree", weighted=True, maxDepth=3)
    return spark.createDataFrame([(r["path"], r["feature"], r["op"], r["threshold"]) for r in models.tree_splits(model, FEATURES)], "path string, feature string, op string, threshold double")


@query()
def tree_tuned(spark, d):
    t = _table(spark, d)
    _, results = models.tuned(t.where("vec_id % 2 = 0"), t.where("vec_id % 2 = 1"), FEATURES, "target", maxDepth=[2, 3], minInstancesPerNode=[5])
    return spark.createDataFrame([(r["config"], r["pr_auc"], r["auc"]) for r in results], "config string, pr_auc double, auc double")


@query()
def model_comparison(spark, d):
    t, rows = _table(spark, d), []
    split = [t.where(f"vec_id % 3 = {k}") for k in range(3)]
    for kind, params in {"logistic": {}, "forest": {"numTrees": 10, "seed": 1}, "boosted": {"maxIter": 5, "seed": 1}}.items():
        record = experiments.trained_and_evaluated(*split, FEATURES, "target", "vec_id", kind, **params)
        rows.append((kind, record["val_auc"], record["test_auc"], record["test_pr_auc"]))
    return spark.createDataFrame(rows, "kind string, val_auc double, test_auc double, test_pr_auc double")


@query()
def feature_importance(spark, d):
    t = _table(spark, d)
    model = models.fit(t, FEATURES, "target", "forest", numTrees=10, seed=1)
    rows = [("impurity", *x) for x in models.importances(model, FEATURES)] + [("permutation", *x) for x in models.permutation_importance(model, t, FEATURES, "target")]
    return spark.createDataFrame(rows, "how string, feature string, importance double")


@query("SELECT enrolid, CAST(region = 'ASIA' AS DOUBLE) AS \"region_ASIA\" FROM enrollment", (s.ENROLLMENT_SQL,))
def encoded_names(spark, d):
    rows = s.enrollment(spark, d).select("enrolid", "region")
    return prepare.Preprocessor.fit(rows, "enrolid", {"categorical": ["region"], "numeric": [], "binary": []}).transform(rows).select("enrolid", "region_ASIA")
