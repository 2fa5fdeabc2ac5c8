"""Literal cases worked out by hand."""

import itertools
import math
import pathlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import claims as fc
from tessera.operators import adherence, cohort, costs, curate, distance, experiments, kernels, metrics, models, onehot, prepare, profile, reports, resample
from tessera.plans import registry
from tessera.plans.queries import QUERIES
from tessera.sources import readers, writers


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_null_condition_leaks_unless_safe(spark):
    rows = spark.createDataFrame([(1, "E11", None, 10.0), (2, "I10", None, 10.0), (3, "I10", "Z00", 10.0), (4, None, None, None)], "id int, DX1 string, DX2 string, cost double")
    for safe, want in ((False, [0, 0, 10, 0]), (True, [0, 10, 10, 0])):
        cond = fc.matches_any(["DX1", "DX2"], lambda c: c.rlike("^E11"), safe)
        m = costs.typed_costs("cost", cond, fc.in_any(["DX1", "DX2"], ["I10"], safe), F.lit(False), {2017: 1.0}, F.lit(2017))
        assert [r[0] for r in rows.orderBy("id").select(m["comorbidity_only_cost"]).collect()] == want


def test_top_k_drops_null_after_the_limit(spark):
    codes = [None] * 5 + ["A"] * 4 + ["B"] * 3 + ["C"]
    assert onehot.top_k(spark.createDataFrame([(c,) for c in codes], "c string"), "c", 2) == ["A"]


def test_stage(spark):
    df = spark.createDataFrame([("N183", None), ("N189", None), ("I10", None), ("I10", "N185x")], "a string, b string")
    assert [r[0] for r in df.select(fc.disease_stage(["a", "b"])).collect()] == [3, 0, None, 5]


def quarters(spark, *q):
    return spark.createDataFrame([(1, *map(float, q))], "id int, " + ", ".join(f"2017Q{i}_c double" for i in (1, 2, 3, 4)))


def test_moments(spark):
    r = costs.moments(quarters(spark, 0, 0, 0, 4), 2017, "c", keep_spread=True).first()
    assert r["c_quarterly_std_2017"] ** 2 == pytest.approx(3)
    assert [round(r[f"c_quarterly_{n}_2017"], 6) for n in ("skewness", "kurtosis", "cv", "range")] == [1.154701, -0.666667, 1.732051, 4]
    assert (r["c_pattern_2017"], r["c_stability_2017"]) == ("late_heavy", "highly_volatile")


def test_flat_year(spark):
    df = costs.moments(quarters(spark, 5, 5, 5, 5).withColumns(costs.derivatives(2017, "c")), 2017, "c").first()
    assert (df["c_total_increasing_2017"], df["c_consistently_decreasing_2017"], df["c_quarterly_skewness_2017"], df["c_quarterly_cv_2017"]) == (0, 1, 0, 0)
    assert (df["c_pattern_2017"], df["c_stability_2017"]) == ("balanced", "stable")


def test_gower(spark):
    rows = spark.createDataFrame([(1, 1, "B", 0.0), (2, 0, "C", 0.25), (3, 0, "A", 1.0)], "id int, f int, c string, n double")
    space = prepare.GowerSpace.fit(rows, "id", {"binary": ["f"], "categorical": ["c"], "numeric": ["n"]})
    got = {r.id: (np.array([r.b]), np.array([r.v])) for r in space.vectors(rows).collect()}
    assert distance.gower_kernel(*got[1], *got[2])[0, 0] == pytest.approx(0.8125)
    with pytest.raises(ValueError, match="0 and 1"):
        distance.gower_kernel(np.array([[0.5]]), np.zeros((1, 0)), np.array([[1.0]]), np.zeros((1, 0)))


def test_farthest_first():
    x = np.array([0, 1, 2, 3, 10.0])
    assert kernels.farthest_first(lambda i: abs(x - x[i]), 5, 0, 4)[0] == [0, 4, 3, 1]


def test_assignment_example():
    assert kernels.match(np.array([[1, 2], [1, 10.0]])) == [(0, 1), (1, 0)]


@pytest.mark.parametrize("seed", range(12))
def test_matching_against_all_matchings(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 5), 5
    cost = rng.integers(0, 20, (n, m)).astype(float)
    pairs = kernels.match(cost)
    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), int(n)))
    assert sum(cost[a, b] for a, b in pairs) == best and len({b for _, b in pairs}) == n
    if n <= 2:
        pairs = kernels.match(cost, ratio=2)
        best = min(sum(cost[0, list(p[:2])]) + (sum(cost[1, list(p[2:])]) if n == 2 else 0) for p in itertools.permutations(range(m), 2 * int(n)))
        assert sum(cost[a, b] for a, b in pairs) == best and len({b for _, b in pairs}) == 2 * n
    shared = kernels.match(cost, ratio=1, capacity=2)
    assert max(np.bincount([b for _, b in shared])) <= 2
    with pytest.raises(ValueError, match="not enough"):
        kernels.match(cost, ratio=6)


TIED = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)]


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, y int")


def test_ranking_metrics_with_ties(spark):
    df = scored(spark, TIED)
    assert metrics.roc_auc(df).first()[0] == 0.875
    assert metrics.average_precision(df).first()[0] == pytest.approx(0.833333, abs=1e-6)
    r = metrics.best_mcc(df).first()
    assert (round(r.mcc, 6), r.threshold) == (0.57735, 0.25)
    r = metrics.best_balanced(df).first()
    assert (round(r.value, 6), r.threshold) == (0.707107, 0.8)


def test_constant_scores(spark):
    df = scored(spark, [(0.3, 0), (0.3, 1), (0.3, 0)])
    r = metrics.best_mcc(df).first()
    assert (r.threshold, r.mcc, r.recall, r.specificity) == (1.3, 0, 0, 1)
    assert tuple(metrics.recall_at_specificity(df, 0.5).first()) == (1.3, 0, 1)
    assert metrics.best_balanced(df).first().threshold == 1.3
    r = metrics.best_mcc(df, constant="all").first()
    assert (r.recall, r.specificity) == (1, 0)
    one = scored(spark, [(0.3, 1), (0.4, 1)])
    assert metrics.roc_auc(one).first()[0] is None and metrics.best_mcc(one).first().mcc is None


@pytest.mark.parametrize("seed", range(3))
def test_metrics_against_definitions(spark, seed):
    rng = np.random.default_rng(seed)
    s, y = rng.integers(0, 40, 300) / 40, rng.integers(0, 2, 300)
    df = scored(spark, [(float(a), int(b)) for a, b in zip(s, y, strict=True)])
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    ap = prev = 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / y.sum()
        ap, prev = ap + (recall - prev) * y[hit].mean(), recall
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)
    grouped = metrics.roc_auc(df.withColumn("g", F.lit(1)), by=["g"]).first()
    assert grouped.auc == pytest.approx(auc)
    assert metrics.best_mcc(df).first()[:] == pytest.approx(metrics.best_mcc(df.withColumn("g", F.lit(1)), by=["g"]).first()[1:])
    a, b = metrics.best_balanced(df).first(), metrics.best_balanced(df.withColumn("g", F.lit(1)), by=["g"]).first()
    assert tuple(a) == pytest.approx(tuple(b)[1:])


def test_evaluation_record(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), int(rng.random() < a / 12), int(i % 2)) for i, a in enumerate(rng.integers(0, 10, 400))]
    df = spark.createDataFrame(rows, "score double, y int, part int")
    val, test = df.where("part = 0"), df.where("part = 1")
    got = metrics.evaluation(val, test)
    t = metrics.best_f1(val).first().threshold
    c = metrics.confusion(test, t).first()
    assert got["threshold_f1"] == t and got["f1_f1"] == pytest.approx(c.f1) and got["mcc_f1"] == pytest.approx(c.mcc) and got["specificity_f1"] == pytest.approx(c.specificity)
    assert got["test_auc"] == pytest.approx(metrics.roc_auc(test).first()[0]) and got["threshold_mcc"] == metrics.best_mcc(val).first().threshold


def test_leaf_refit(spark):
    fit = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0)], "leaf int, y int")
    rows = spark.createDataFrame([(1,), (2,), (9,)], "leaf int")
    assert sorted(values(metrics.refit_scores(fit, rows), "leaf", "refit_score")) == [(1, 0.5), (2, 0.0), (9, 0.25)]


def test_weights(spark):
    rows = lambda *x: spark.createDataFrame([(i, [v]) for i, v in x], "vec_id long, v array<double>")
    assert [round(w, 6) for _, w in sorted(values(curate.boundary_weights(rows((7, 0.0), (8, 10.0)), rows((1, 1.0), (2, 13.0))), "b_id", "weight"))] == [1.5, 0.5]


def test_tiles_and_reductions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (70, 4)).astype(float)
    make = lambda ids: spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], "vec_id long, v array<double>")
    a, b = make(range(45)), make(range(30, 70))
    full = distance.kernel(x[:45], x[30:], "manhattan")
    off = full[np.arange(45)[:, None] != np.arange(30, 70)[None]]

    def results():
        pairs = sorted(values(distance.pairwise(a, b, "manhattan"), "a_id", "b_id", "dist"))
        near = sorted(values(distance.nearest(a, b, 3, "manhattan"), "a_id", "rank", "b_id", "dist"))
        far = sorted(values(distance.nearest(a, b, 2, "manhattan", farthest=True), "a_id", "rank", "b_id", "dist"))
        sums = sorted(values(distance.summaries(a, b, "manhattan", under=4.0), "a_id", "n", "total", "least", "largest", "near"))
        stored = sorted((r.id, o, d) for r in distance.distance_rows(a, b, "manhattan").collect() for o, d in zip(r.others, r.dist, strict=True))
        return pairs, near, far, sums, stored, [distance.distance_quantile(a, b, q, "manhattan") for q in (0.0, 0.1, 0.37, 1.0)]

    whole = results()
    monkeypatch.setattr(distance, "BLOCK_BYTES", 0)
    monkeypatch.setattr(distance, "TILE_BYTES", 1000)
    assert results() == whole
    monkeypatch.setattr(distance, "READ", 5)
    assert results()[5] == whole[5] == [pytest.approx(np.quantile(off, q)) for q in (0.0, 0.1, 0.37, 1.0)]
    assert whole[0] == [(i, 30 + j, full[i, j]) for i in range(45) for j in range(40)] == whole[4]
    assert whole[3] == [(i, 40, r.sum(), r.min(), r.max(), int(((r > 0) & (r < 4)).sum())) for i, r in enumerate(full)]
    for i in range(45):
        order = sorted((full[i, j], 30 + j) for j in range(40) if 30 + j != i)
        assert [(r[2], r[3]) for r in whole[1] if r[0] == i] == [(o, d) for d, o in order[:3]]
        order = sorted((-full[i, j], 30 + j) for j in range(40) if 30 + j != i)
        assert [(r[2], r[3]) for r in whole[2] if r[0] == i] == [(o, -d) for d, o in order[:2]]
    assert distance.pairwise(a, b.limit(0)).collect() == []


def one_table(spark, monkeypatch):
    """Controls and cases of one table, with tiles for all sets: (vectors by id of each, the frames)."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(i % 4 == 0)) for i in range(60)], "vec_id long, v array<double>, target int")
    monkeypatch.setattr(distance, "BLOCK_BYTES", 0)
    monkeypatch.setattr(distance, "TILE_BYTES", 2000)
    part = lambda t: np.array([i for i in range(60) if int(i % 4 == 0) == t])
    return x, part(0), part(1), df.where("target = 0"), df.where("target = 1")


def test_tiles_of_one_table(spark, monkeypatch):
    x, a, b, controls, cases = one_table(spark, monkeypatch)
    least = np.abs(x[b][:, None] - x[a][None]).sum(2).min(1)
    w = 1 / (least + 1e-8)
    got = dict(values(curate.boundary_weights(controls, cases, "manhattan"), "b_id", "weight"))
    assert got == {int(i): pytest.approx(v) for i, v in zip(b, w / w.mean(), strict=True)}


def test_sampled_gaps_by_tiles(spark, monkeypatch):
    x, a, b, controls, cases = one_table(spark, monkeypatch)
    for others, ids in ((cases, b), (controls, a)):
        got = {r.a_id: (r.b_id, r.gaps) for r in distance.sampled_gaps(controls, others).collect()}
        assert got == {int(i): (int(ids[i % len(ids)]), np.abs(x[i] - x[ids[i % len(ids)]]).tolist()) for i in a}


def test_mean_gaps_are_of_all_pairs(spark, monkeypatch):
    x, a, b, controls, cases = one_table(spark, monkeypatch)
    for others, near, n in ((cases, x[b], len(a) * len(b)), (None, x[a], len(a) * (len(a) - 1))):
        want = np.abs(x[a][:, None] - near[None]).sum((0, 1)) / n
        for ranges in (2, 16):
            monkeypatch.setattr(distance, "RANGES", ranges)
            assert dict(values(distance.mean_gaps(controls, others), "feature", "mean_gap")) == {j: pytest.approx(v) for j, v in enumerate(want)}
    odd = spark.createDataFrame([(1, [1.0, None, 2.0]), (2, [4.0, 7.0, 2.0]), (2, [5.0, 3.0, 2.0])], "vec_id long, v array<double>")
    assert sorted(values(distance.mean_gaps(odd), "feature", "mean_gap")) == [(0, pytest.approx(8 / 3)), (1, 4.0), (2, 0.0)]
    assert sorted(values(distance.mean_gaps(odd.limit(1)), "feature", "mean_gap")) == [(0, None), (2, None)] and distance.mean_gaps(odd.limit(0)).count() == 0


def test_contribution_ratio_takes_all_pairs(spark, tmp_path):
    rows = [(0, [0.0] * 64, 1), (1, [4.0] * 64, 1), (2, [9.0] * 64, 1), (3, [1.0] * 64, 0), (4, [7.0] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    between, within = (1 + 7 + 3 + 3 + 8 + 2) / 6, (4 + 9 + 5) / 3
    assert values(QUERIES["contribution_ratio"](spark, str(tmp_path)), "ratio") == [(pytest.approx(between / within, abs=1e-5),)] * 64


def test_hardest_cases_by_tiles(spark, monkeypatch):
    x, a, b, controls, cases = one_table(spark, monkeypatch)
    least = np.abs(x[b][:, None] - x[a][None]).sum(2).min(1)
    assert values(curate.hardest_cases(controls, cases, 4, "manhattan"), "b_id", "least") == sorted(((int(i), v) for i, v in zip(b, least, strict=True)), key=lambda r: (r[1], r[0]))[:4]


@pytest.mark.parametrize("seed", range(20))
def test_matching_over_edges(seed):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 9, (rng.integers(1, 6), 7)).astype(float)
    n, m = cost.shape
    i, j = np.divmod(np.arange(n * m), m)
    for ratio, capacity in ((1, 1), (1, 2), (2, 2)):
        chosen, u, v, stuck = kernels.match_edges(i, j, cost.ravel(), n, m, ratio, capacity)
        assert not stuck and cost[i[chosen], j[chosen]].sum() == pytest.approx(sum(cost[p] for p in kernels.match(cost, ratio, capacity)))
        assert np.bincount(i[chosen], minlength=n).tolist() == [ratio] * n and np.bincount(j[chosen]).max() <= capacity
        assert (v <= 0).all() and (np.delete(cost - u[:, None] - v, chosen) >= -1e-9).all()
    assert kernels.match_edges(np.array([0, 1]), np.array([0, 0]), np.ones(2), 2, 1)[3] == {0, 1}


def test_matching_finds_the_edges_it_needs(spark, monkeypatch):
    x, a, b, controls, cases = one_table(spark, monkeypatch)
    monkeypatch.setattr(curate, "EDGES", 1)
    cost = np.abs(x[b][:, None] - x[a][None]).sum(2)
    for ratio, capacity in ((1, 1), (2, 1), (1, 2)):
        least = sum(cost[p] for p in kernels.match(cost, ratio, capacity))
        for got in (curate.matched_vectors(controls, cases, ratio, capacity, metric="manhattan"), curate.matched(distance.pairwise(controls, cases, "manhattan"), ratio, capacity)):
            rows = got.collect()
            assert len({(r.case_id, r.control_id) for r in rows}) == len(b) * ratio and sum(r.cost for r in rows) == pytest.approx(least)


def test_picks_in_the_cluster(spark, monkeypatch):
    x, a, b, controls, cases = one_table(spark, monkeypatch)
    rows = controls.unionByName(cases).withColumn("leaf", F.col("vec_id") % 2)
    seed = int(a[3])

    def results():
        picks = [curate.dispersed(controls, 25, seed, "manhattan"), curate.dispersed(controls, 12, seed, "manhattan", how="d2", random_state=3)]
        picks.append(curate.adaptive_pool(controls, cases, 30, seed, "manhattan", tau=0.0))
        return [values(p.orderBy("pick_order"), "id") for p in picks] + [sorted(values(curate.dispersed_by_leaf(rows, "leaf", 1, 9, "manhattan"), "leaf", "pick_order", "id"))]

    at_once = results()
    d = np.abs(x[a][:, None] - x[a][None]).sum(2)
    assert [i for (i,) in at_once[0]] == a[kernels.farthest_first(lambda i: d[i], len(a), 3, 25)[0]].tolist()
    monkeypatch.setattr(curate, "POOL_BYTES", 0)
    monkeypatch.setattr(kernels, "AHEAD", 6)
    assert results() == at_once


def test_adaptive_pool_ends_by_its_rule(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(900, 4)), 3)
    target = np.arange(900) % 3 == 0
    rows = [(i, [float(v) for v in x[i]], int(i % 3)) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = values(QUERIES["adaptive_pool"](spark, str(tmp_path)).orderBy("pick_order"), "id")
    a = np.flatnonzero(~target)
    between, within = distance.kernel(x[a], x[target], "euclidean"), distance.kernel(x[a], x[a], "euclidean")
    picks, radii = kernels.farthest_first(lambda i: within[i], len(a), int(((x[a] - x[a].mean(0)) ** 2).sum(1).argmin()), len(a))
    tau, means = np.quantile(between.min(0), 0.95), {n: between[picks[:n]].min(0).mean() for n in range(100, 601, 100)}
    end = next(n for n in range(300, 601) if n == 600 or radii[n] <= tau or (n > 300 and n % 100 == 0 and (means[n - 100] - means[n]) / means[n - 100] <= 0.01))
    assert [i for (i,) in got] == a[picks[:end]].tolist() and end >= 300


def test_summary_of_distances(spark, monkeypatch):
    x, a, b, controls, cases = one_table(spark, monkeypatch)
    monkeypatch.setattr(distance, "READ", 3)
    d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2)).ravel()
    got = curate.distance_summary(controls, cases).first()
    assert tuple(got) == (pytest.approx(d.mean()), pytest.approx(np.quantile(d, 0.5)), pytest.approx(np.quantile(d, 0.9)), d.size)


def test_quantiles_by_histograms(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.lognormal(0, 3, 400), 1)
    df = spark.createDataFrame([(float(v), i % 3 if i else None, None) for i, v in enumerate(x)], "a double, b int, c double")
    monkeypatch.setattr(profile, "READ", 3)
    monkeypatch.setattr(profile, "BINS", 8)
    shares = (0.0, 0.25, 0.5, 0.77, 1.0)
    got = profile.quantiles(df, ["a", "b", "c"], shares)
    assert got["a"] == pytest.approx(np.quantile(x, shares)) and got["b"] == pytest.approx(np.quantile([i % 3 for i in range(1, 400)], shares)) and got["c"] == [None] * 5
    odd = spark.createDataFrame([(float(v),) for v in ("-inf", "1", "2", "inf", "nan")], "a double")
    assert str(profile.quantiles(odd, ["a"], (0.0, 0.25, 0.5, 0.75, 1.0))["a"]) == "[-inf, 1.0, 2.0, inf, nan]"
    row = profile.described(df, ["a", "c"]).where("feature = 'a'").first()
    assert (row.n, row.q50, row.max) == (400, pytest.approx(np.median(x)), x.max())


def test_stored_rows_are_short(spark):
    rows = spark.range(1500).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("v"))
    got = distance.distance_rows(rows.where("vec_id < 3"), rows, "manhattan")
    assert got.agg(F.max(F.size("others")), F.max(F.size("dist")), F.sum(F.size("dist"))).first()[:] == (1024, 1024, 4500)


def test_empty_isin_is_false(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    assert [r[0] for r in df.select(F.coalesce(fc.in_any(["c"], []), F.lit(False))).collect()] == [False, False]


def test_binary_detector(spark):
    df = spark.createDataFrame([(0.0, None, 0.0, 0.0), (1.0, None, 2.0, 1 + 5e-7), (None, None, 2.0, 1.0)], "a double, b double, c double, d double")
    assert profile.binary_columns(df) == ["a"]
    assert profile.binary_columns(df, tolerance=1e-6) == ["a", "d"]


def test_target_names(spark):
    assert cohort.percent_name(0.005) == "0_5" and cohort.percent_name(0.1) == "10"
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "annual_cost_2018 double")
    assert cohort.labels_from_name(df, "top_0_5_pct_cost_2018").agg(F.sum("top_0_5_pct_cost_2018")).first()[0] == 6
    with pytest.raises(ValueError, match="target"):
        cohort.labels_from_name(df, "other")


def test_schema_rules(spark):
    df = spark.createDataFrame([], "DX10 string, PDX string, dx2 string, PAY double, RX string, day string")
    assert fc.diagnosis_columns(df) == ["dx2", "DX10", "PDX"] and fc.cost_column(df) == "PAY"
    assert dict(fc.as_date(df, "day").dtypes)["day"] == "date"
    with pytest.raises(ValueError, match="diagnosis"):
        fc.diagnosis_columns(df.select("PAY"))
    with pytest.raises(ValueError, match="cost"):
        fc.cost_column(df.select("PDX"))
    named = spark.createDataFrame([], "`a b` int, `a-b` int, c int")
    assert fc.renamed(named).columns == ["a_b", "a_b_2", "c"]
    assert profile.without_year(["x_2017", "y_2018", "z"], [2018]) == ["x_2017", "z"]
    assert profile.feature_set(["has_x", "total_cost", "q1_cost"], "less_cost") == ["has_x", "total_cost"]
    assert profile.feature_group("Q1_COST", [("cost", "money")]) == "money"


def test_year_filter_reaches_the_scan(spark):
    from tessera.plans.standins import claims

    plan = claims(spark, "/root/testdata/sf0.001").where(fc.in_years("svcdate", [1997, 1998]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_results_do_not_depend_on_partitions(spark):
    from tessera.plans.standins import vectors

    v = vectors(spark, "/root/testdata/sf0.001")
    for f in (lambda d: distance.nearest(d.where("target = 1"), d.where("target = 0"), 3), lambda d: resample.near_miss(d, 3), lambda d: prepare.stratified_split(d, "target", key="vec_id"), lambda d: resample.smote(d, 20), lambda d: curate.dispersed(d.where("target = 0"), 20, curate.seed_centroid(d.where("target = 0"), "vec_id")).drop("radius")):
        a, b = (sorted(str(tuple(r)) for r in f(x).collect()) for x in (v, v.repartition(13)))
        assert a == b


def test_dispersed_invariants(spark):
    from tessera.plans.standins import vectors

    v = vectors(spark, "/root/testdata/sf0.001").where("target = 0")
    picks = curate.dispersed(v, 30, curate.seed_centroid(v, "vec_id")).orderBy("pick_order").collect()
    radii = [p.radius for p in picks[1:]]
    assert len({p.id for p in picks}) == 30 and all(a >= b - 1e-9 for a, b in zip(radii, radii[1:], strict=False))
    candidates, matches = curate.two_stage(vectors(spark, "/root/testdata/sf0.001"), 100)
    m = matches.collect()
    assert len({x.control_id for x in m}) == len(m) == vectors(spark, "/root/testdata/sf0.001").where("target = 1").count()
    assert {x.control_id for x in m} <= {c.id for c in candidates.collect()}
    with pytest.raises(ValueError, match="weighting"):
        curate.two_stage(v, 5, weighting="uncertainty")


def test_adaptive_matching(spark):
    d = spark.createDataFrame([(a, b, float(abs(3 * a - b))) for a in range(6) for b in range(4)], "a_id long, b_id long, dist double")
    full, sparse = curate.matched(d), curate.matched(d, cheapest=1)
    total = lambda x: x.agg(F.sum("cost")).first()[0]
    assert sparse.count() == 4 and total(full) <= total(sparse)


def test_grids():
    g = curate.grid(cw=["none", "b"], pool=[100], seed=[1, 2])
    assert len(g) == 4 and curate.parse_config(g[0]["config"], ["cw", "pool", "seed"]) == {"cw": "none", "pool": "100", "seed": "1"}


def test_preprocessor_imputes_and_scales(spark):
    rows = spark.createDataFrame([(1, 1.0, "a"), (2, 3.0, None), (3, None, "b"), (4, 5.0, "a")], "id int, x double, c string")
    p = prepare.Preprocessor.fit(rows, "id", {"numeric": ["x"], "categorical": ["c"]})
    got = {r.id: r for r in p.transform(rows.unionByName(spark.createDataFrame([(5, 3.0, "new")], rows.schema))).collect()}
    x = np.array([1, 3, 3, 5.0])
    assert [round(got[i].x, 9) for i in (1, 2, 3, 4)] == pytest.approx((x - x.mean()) / x.std())
    assert [got[i].c_b for i in (1, 2, 3, 5)] == [0, 0, 1, 0] and p.feature_names() == ["c_b", "x"]


def test_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got = np.array([r.v for r in prepare.truncated_svd(df, "id", 2).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(got, axis=0), np.linalg.svd(x)[1][:2])


def test_adherence_levels(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "a int, b int")
    assert values(adherence.composite(df, {"a": 0.5, "b": 0.5}), "adherence_level") == [("excellent",), ("good",), ("poor",)]


def test_targets_and_recipes(spark):
    df = spark.createDataFrame([(v,) for v in [-1, -1, 1, None]], "t int")
    assert [r[0] for r in profile.binary_target(df, "t").collect()] == [0, 0, 1, None]
    df = spark.createDataFrame([(v,) for v in [5, 5, 7]], "t int")
    assert [r[0] for r in profile.binary_target(df, "t").collect()] == [0, 0, 1]
    assert reports.jaccard_of_tops(["a", "b"], ["b", "c"]) == pytest.approx(1 / 3)


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 4), float(s), int(rng.random() < 0.2 + 0.1 * s)) for i, s in enumerate(rng.integers(0, 5, 800))]
    df = spark.createDataFrame(rows, "leaf int, score double, y int")
    r = metrics.bootstrap_excess(df, replicates=100).first()
    assert r.estimate == pytest.approx(metrics.weighted_excess_auc(df).first().excess) and r.low < r.estimate < r.high and 0 <= r.p_greater <= 1


def test_bootstrap_of_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), int(rng.random() < 0.1 + 0.15 * a)) for a, b in rng.integers(0, 5, (600, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    one = {r.measure: r for r in metrics.bootstrap_scores(df, ["a"], replicates=100).collect()}
    assert one["auc"].estimate == pytest.approx(metrics.roc_auc(df, "a").first()[0]) and one["auc"].low < one["auc"].estimate < one["auc"].high
    assert one["average_precision"].estimate == pytest.approx(metrics.average_precision(df, "a").first()[0])
    two = {r.measure: r for r in metrics.bootstrap_scores(df, ["a", "b"], replicates=100).collect()}
    assert two["auc"].p_greater < 0.05 and two["auc"].estimate == pytest.approx(one["auc"].estimate - metrics.roc_auc(df, "b").first()[0])


def test_leaf_choice_and_split_tables(spark):
    leaves = spark.createDataFrame([(1, 50, 0.1), (2, 40, 0.2), (3, 5, 1.9), (4, 6, 1.0)], "leaf int, n int, entropy double")
    assert [r.leaf for r in reports.selected_leaves(leaves, "leaf", 2).collect()] == [1, 2]
    assert sorted(r.leaf for r in reports.selected_leaves(leaves, "leaf", 4, "diverse").collect()) == [1, 2, 3, 4]
    a = spark.createDataFrame([("root", "x"), ("L", "y")], "path string, feature string")
    d = {r.path: (r.feature_a, r.feature_b, r.in_a, r.in_b) for r in reports.split_difference(a, a.where("path = 'root'")).collect()}
    assert d == {"root": ("x", "x", 1, 1), "L": ("y", None, 1, 0)} and reports.split_usage(a).count() == 2
    assert [r.v for r in reports.in_order(spark.createDataFrame([("a",), ("b",), ("c",)], "v string"), "v", ["c", "a"]).collect()] == ["c", "a", "b"]


def test_down_sampling(spark):
    df = spark.range(4000).selectExpr("id AS enrolid", "CAST(id % 4 = 0 AS INT) AS y")
    out = cohort.down_sample(df, "y", 1000, 800)
    assert cohort.down_sample(df, "y", 5000, 800).count() == 4000 and 650 < out.count() < 950
    assert 0.2 < out.agg(F.avg("y")).first()[0] < 0.3


def test_strata_cuts_match_a_plain_ranking(spark):
    df = spark.range(900).selectExpr("id AS enrolid", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 3 END AS g")
    split = {r.enrolid: r.split for r in prepare.stratified_split(df, "g", (0.5, 0.5), ("a", "b")).collect()}
    from hashlib import sha256

    for g in (None, 0, 1, 2):
        ids = sorted((i for i in range(900) if (None if i % 10 == 0 else i % 3) == g), key=lambda i: sha256(f"0:{i}".encode()).hexdigest())
        assert [split[i] for i in ids] == ["a"] * round(len(ids) * 0.5 + 1e-9) + ["b"] * (len(ids) - round(len(ids) * 0.5 + 1e-9))
    assert prepare.first_of_strata(df, "g", {0: 10, 1: 10_000}, "enrolid", 0).groupBy("g").count().orderBy("g").collect()[0]["count"] == 10


def test_hard_subsets_and_gates(spark):
    df = spark.createDataFrame([(i, i / 100, int(i % 10 == 0)) for i in range(100)], "id int, composite double, y int")
    assert metrics.hard_subset(df, 10).where("y = 0").count() == 9
    assert [r.hybrid for r in metrics.gated(df.limit(2), "composite", 0.01, "id", "y").orderBy("id").collect()] == [1, 1]


def test_models(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b), int(a > 0.5)) for a, b in rng.random((400, 2))], "a double, b double, y int")
    model, results = models.tuned(df, df, ["a", "b"], "y", maxDepth=[1, 2])
    out = models.predict(model, df, ["a", "b"])
    assert metrics.roc_auc(out).first()[0] > 0.98 and len(results) == 2
    assert models.importances(model, ["a", "b"])[0][0] == "a"
    assert models.tree_splits(model, ["a", "b"])[0]["feature"] == "a" and models.leaf_count(out).first()[0] >= 2


def test_sources(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for code in ("C1", "C2"):
        writers.write_parquet(df, f"{base}/{code}_claims")
    writers.write_parquet(df, f"{base}/C1_enrollment")
    assert readers.cohorts(spark, base) == ["C1"]
    writers.upsert(spark, df, f"{base}/t.parquet", ("id",))
    writers.upsert(spark, spark.createDataFrame([(2, "c"), (3, "d")], df.schema), f"{base}/t.parquet", ("id",))
    assert sorted(map(tuple, readers.read_any(spark, f"{base}/t.parquet").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    writers.append_csv(df, f"{base}/log.csv")
    writers.append_csv(df, f"{base}/log.csv")
    assert readers.read_any(spark, f"{base}/log.csv", columns=["v"]).count() == 4
    writers.write_json_document(spark, {"k": [1, 2]}, f"{base}/meta.json")
    assert readers.read_json_document(spark, f"{base}/meta.json") == {"k": [1, 2]} and readers.read_json_document(spark, f"{base}/none.json", {}) == {}
    assert readers.feature_file(spark, base, "x") if readers.exists(spark, f"{base}/x_features.parquet") else True
    with pytest.raises(FileNotFoundError):
        readers.feature_file(spark, base, "x")
    with pytest.raises(ValueError, match="format"):
        readers.read_any(spark, "a.xyz")
    assert writers.remembered(spark, f"{base}/memo", lambda: df).count() == 2 and writers.remembered(spark, f"{base}/memo", lambda: 1 / 0).count() == 2
    assert readers.seeds("1, 3-5") == [1, 3, 4, 5] and readers.runs(["x/depth5_splits.csv"], r"depth(?P<d>\d+)_")[0]["d"] == "5"
    assert writers.distance_path("r", "gower", "nn", 3) == "r/metric=gower/kind=nn/seed=3"


def test_entropy_of_leaves(spark):
    df = spark.createDataFrame([(1, 10_000.0), (1, 60_000.0), (1, 150_000.0), (1, 300_000.0)], "leaf int, cost double")
    r = reports.leaf_strata(df, "leaf", "cost").first()
    assert r.entropy == pytest.approx(2) and r.dominant == 0 and math.isclose(r.share_3, 0.25)


def test_entry_without_the_text_operators(monkeypatch):
    import importlib
    import sys

    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert "pipeline" not in bare.queries() and "roc_auc" in bare.queries() and set(bare.oracle_sql()) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def _unmade(*_):
    raise AssertionError("doubles of all pairs were made")


@pytest.mark.parametrize("k, farthest", [(1, False), (3, False), (3, True), (80, False)])
def test_near_pairs_by_coarse_distances(monkeypatch, k, farthest):
    rng = np.random.default_rng(k)
    b = np.round(rng.normal(size=(500, 9)), 1)
    b[100:140] = b[:40]  # copies: ties are in
    b_ids = rng.permutation(500)
    a, a_ids = b[:40], b_ids[:40]
    every = distance.kernel(a, b, "manhattan")
    every[a_ids[:, None] == b_ids[None]] = np.nan
    monkeypatch.setattr(distance, "kernel", _unmade)
    q, i, d = distance.near_pairs(a_ids, a, b_ids, b, k, "manhattan", True, farthest)
    assert (every[q, i] == d).all()
    for row in range(40):
        rank = sorted(((-x if farthest else x), n) for x, n in zip(every[row], b_ids, strict=True) if x == x)[:k]
        assert sorted(((-x if farthest else x), n) for x, n in zip(d[q == row], b_ids[i[q == row]], strict=True))[:k] == rank


def _clustered(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = np.round(4 * rng.normal(size=(300, 6))) / 4, rng.integers(0, 2, 300)  # sums are exact
    df = spark.createDataFrame([(n, x[n].tolist(), int(y[n])) for n in range(300)], "vec_id long, v array<double>, target int")
    d = np.abs(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    monkeypatch.setattr(distance, "kernel", _unmade)
    return df, y, np.array([np.lexsort((np.arange(300), row))[:3] for row in d])


def test_edited_out_by_coarse_distances(spark, monkeypatch):
    df, y, near = _clustered(spark, monkeypatch)
    assert {r.id for r in resample.edited_out(df, metric="manhattan").collect()} == {n for n in range(300) if not y[n] and y[near[n]].any()}


def test_cleaned_out_by_coarse_distances(spark, monkeypatch):
    df, y, near = _clustered(spark, monkeypatch)
    votes = 2 * y[near].sum(1) > 3
    lost = {int(m) for n in range(300) if y[n] and not votes[n] for m in near[n] if not y[m]}
    assert {r.id for r in resample.cleaned_out(df, metric="manhattan").collect()} == {n for n in range(300) if not y[n] and votes[n]} | lost


def test_crowded_cases_get_edges_by_price(spark, monkeypatch):
    # 60 copies of a case want the same 32 controls: only they need more edges, the other cases keep their first ones
    rng = np.random.default_rng(3)
    case = np.concatenate([np.repeat(rng.normal(size=(1, 4)), 60, axis=0), rng.normal(size=(40, 4)) + 20])
    control = np.concatenate([rng.normal(size=(200, 4)), rng.normal(size=(100, 4)) + 20])
    frame = lambda x, first: spark.createDataFrame([(first + n, r.tolist()) for n, r in enumerate(x)], "vec_id long, v array<double>")
    asked = []
    cheapest_edges = curate.cheapest_edges
    monkeypatch.setattr(curate, "cheapest_edges", lambda controls, cases, k, *rest: asked.append(k) or cheapest_edges(controls, cases, k, *rest))
    got = curate.matched_vectors(frame(control, 0), frame(case, 1000), metric="manhattan").toPandas()
    cost = distance.kernel(case, control, "manhattan")
    assert asked == [curate.EDGES] and got["control_id"].is_unique and len(got) == 100
    assert got["cost"].sum() == pytest.approx(cost[np.arange(100), kernels.assign(cost)].sum())
    twice = curate.matched_vectors(frame(control, 0), frame(case[:90], 1000), ratio=2, metric="manhattan").toPandas()
    assert twice["cost"].sum() == pytest.approx(sum(cost[p] for p in kernels.match(cost[:90], 2)))
    few = spark.createDataFrame([(1, 7, 1.0), (1, 8, 2.0), (2, 7, 1.0)], "a_id long, b_id long, dist double")
    with pytest.raises(ValueError, match="no feasible match"):
        curate.matched(few.unionByName(few.selectExpr("a_id + 10 as a_id", "9L as b_id", "dist")).where("NOT (a_id = 2)"))


def test_seed_density_measures_pairs_twice(spark, monkeypatch):
    # two passes over halves of the pairs, not five over all; copies are no neighbours, whatever tiles they are in
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 7)), 40, axis=0), rng.normal(size=(80, 7))])
    df = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(x)], "vec_id long, v array<double>").repartition(2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = ((d > 0) & (d < np.quantile(d[~np.eye(120, dtype=bool)], 0.3))).sum(1)
    monkeypatch.setattr(curate, "distance_quantile", _unmade)
    monkeypatch.setattr(curate, "summaries", _unmade)
    assert curate.seed_density(df, 0.3) == int(near.argmax())
    monkeypatch.setattr(distance, "TILE_BYTES", 8000)
    monkeypatch.setattr(distance, "FEW", 500)
    assert dict(values(distance.near_counts(df, 0.3), "a_id", "near")) == dict(enumerate(near.tolist()))


@pytest.mark.parametrize("kind", ["normal", "copies", "grid", "heavy"])
def test_near_cells_looks_distances_up(monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=(900, 12)), "grid": rng.integers(0, 3, (900, 5)).astype(float), "heavy": rng.standard_cauchy((900, 7))}.get(kind, np.repeat(rng.normal(size=(300, 6)), 3, axis=0))
    ids = rng.permutation(900)
    every = distance.kernel(x[:400], x, "gower")
    off = np.where(ids[:400, None] == ids[None], np.inf, every)
    if kind != "heavy":
        monkeypatch.setattr(distance, "kernel", _unmade)
        monkeypatch.setattr(distance, "coarse", _unmade)
    for k in (1, 3):
        q, i, d = distance.near_cells(ids[:400], x[:400], ids, x, k, "gower", True)
        assert (every[q, i] == d).all()
        assert set(zip(*np.nonzero(off <= np.sort(off, axis=1)[:, k - 1, None]), strict=True)) <= set(zip(q, i, strict=True))


@pytest.mark.parametrize("rule", ["edited_out", "cleaned_out"])
def test_neighbour_rules_look_distances_up(spark, monkeypatch, rule):
    df, y, near = _clustered(spark, monkeypatch)
    monkeypatch.setattr(distance, "near_pairs", _unmade)
    asked, near_cells = [], distance.near_cells
    monkeypatch.setattr(distance, "near_cells", lambda *a: asked.append(len(a[0])) or near_cells(*a))
    monkeypatch.setattr(distance, "_mapped", lambda rows, others, key, work, schema, merge, steps: spark.createDataFrame(pd.concat(steps(*_sides(rows), *_sides(others), work)), schema))
    votes = 2 * y[near].sum(1) > 3
    lost = {int(m) for n in range(300) if y[n] and not votes[n] for m in near[n] if not y[m]}
    want = {n for n in range(300) if not y[n] and votes[n]} | lost if rule == "cleaned_out" else {n for n in range(300) if not y[n] and y[near[n]].any()}
    assert {r.id for r in getattr(resample, rule)(df, metric="manhattan").collect()} == want and asked == [300]


def _sides(df):
    pdf = df.toPandas()
    return pdf["vec_id"].to_numpy(), np.stack(pdf["v"])


def test_rows_bid_before_searches(monkeypatch):
    # what bids settle needs no search; prices stay those of a least-cost match
    rng = np.random.default_rng(6)
    cost = rng.random((120, 160))
    pops, pop = [], kernels.heapq.heappop
    monkeypatch.setattr(kernels.heapq, "heappop", lambda h: pops.append(1) or pop(h))
    i, j = np.divmod(np.arange(cost.size), 160)
    chosen, u, v, stuck = kernels.match_edges(i, j, cost.ravel(), 120, 160)
    spare = cost.ravel() - u[i] - v[j]
    assert not stuck and cost.ravel()[chosen].sum() == pytest.approx(cost[np.arange(120), kernels.assign(cost)].sum())
    assert spare.min() > -1e-9 and np.abs(spare[chosen]).max() < 1e-9 and v.max() <= 0 and not v[np.setdiff1d(np.arange(160), j[chosen])].any()
    assert not pops


def test_gower_pairs_by_a_join(spark):
    rng = np.random.default_rng(8)
    names = [f"f{j}" for j in range(70)]
    data = [(i, *map(int, rng.integers(0, 2, 70)), None if i == 3 else "ABC"[i % 3], None if i == 5 else float(x), float(i)) for i, x in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(data, f"id int, {', '.join(f'{c} int' for c in names)}, c string, x double, y double")
    roles = {"binary": names, "categorical": ["c"], "numeric": ["x", "y"]}
    space = prepare.GowerSpace.fit(df, "id", roles)
    held = {r.id: (np.array(r.b), np.array(r.v)) for r in space.vectors(df).collect()}
    for few, many in (("id < 7", "id >= 7"), ("id >= 7", "id < 7")):
        got = experiments.gower_distances(space, df.where(few), df.where(many))
        assert "MapInPandas" not in got._jdf.queryExecution().toString()
        assert got.dtypes == [("a_id", "bigint"), ("b_id", "bigint"), ("dist", "double")]
        found = {(r.a_id, r.b_id): r.dist for r in got.collect()}
        assert len(found) == 7 * 33
        for (a, b), d in found.items():
            assert d == distance.gower_kernel(held[a][0][None], held[a][1][None], held[b][0][None], held[b][1][None])[0, 0]
    assert experiments.gower_distances(space, df.where("id < 0"), df).count() == 0
    with pytest.raises(Exception, match="0 and 1"):
        experiments.gower_distances(space, df.withColumn("f3", F.lit(0.5)), df).collect()


def test_gower_rows_alike_share_distances(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    data = [(int(i), int(i % 2), float(x)) for i, x in zip(rng.permutation(2400), np.repeat(rng.normal(size=40), 60), strict=True)]
    df = spark.createDataFrame(data, "id long, f int, x double").repartition(8, "id")
    space = prepare.GowerSpace.fit(df, "id", {"binary": ["f"], "numeric": ["x"]})
    path = f"{tmp_path}/pairs"
    experiments.gower_distances(space, df.where("id % 4 > 0"), df.where("id % 4 = 0")).write.parquet(path)
    assert spark.read.parquet(path).select("a_id", "b_id").distinct().count() == 1800 * 600
    dist = [pq.read_table(f, columns=["dist"])["dist"].to_numpy() for f in pathlib.Path(path).glob("*.parquet")]
    assert sum((d[1:] != d[:-1]).sum() for d in dist) < 1800 * 600 / 20  # else a column of distances takes room for each row
    # More rows alike than share a distance at once, repeated and null ids.
    monkeypatch.setattr(experiments, "ALIKE", 4)
    few = spark.createDataFrame([(i if i < 11 else None, 1, 0.5) for i in range(12)] + [(3, 1, 0.5), (20, 0, 1.5)], "id long, f int, x double")
    space = prepare.GowerSpace.fit(few, "id", {"binary": ["f"], "numeric": ["x"]})
    ids = [r.id for r in few.collect()]
    for rows, others in ((few, few.limit(13)), (few.limit(13), few)):
        want = [(a, b, float(20 in (a, b))) for a in ids[: rows.count()] for b in ids[: others.count()]]
        assert sorted(values(experiments.gower_distances(space, rows, others), "a_id", "b_id", "dist"), key=str) == sorted(want, key=str)


def test_rounded_is_round(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=2000), rng.normal(size=2000) * 1e7, rng.integers(-(10**7), 10**7, 2000) / 2e4 * 1e-2, np.round(rng.random(2000), 7)])
    x = [*x.tolist(), 0.0, -0.0, 1e300, -2e13, 1e-300, 0.5, -2.5, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for n in (0, 2, 4, 6, 9):
        assert df.where(~registry.rounded(F.col("x"), n).cast("string").eqNullSafe(F.round("x", n).cast("string"))).count() == 0  # -0.0 is not 0.0


@pytest.mark.parametrize("kind", ["normal", "copies", "grid", "heavy"])
def test_near_cells_serve_both_sides(spark, monkeypatch, kind):
    rng = np.random.default_rng(6)
    x = {"normal": rng.normal(size=(900, 12)), "grid": rng.integers(0, 3, (900, 5)).astype(float), "heavy": rng.standard_cauchy((900, 7))}.get(kind, np.repeat(rng.normal(size=(300, 6)), 3, axis=0))
    ids = rng.permutation(900)
    every = distance.kernel(x[:400], x[400:], "manhattan")
    for k in (1, 3):
        q, i, d = distance.near_cells(ids[:400], x[:400], ids[400:], x[400:], k, "manhattan", True, True)
        assert (every[q, i] == d).all()
        near = (every <= np.sort(every, axis=1)[:, k - 1, None]) | (every <= np.sort(every, axis=0)[k - 1])
        assert set(zip(*np.nonzero(near), strict=True)) <= set(zip(q, i, strict=True))
    # Large sets: each two tiles meet once, no pair of tiles is dealt twice.
    monkeypatch.setattr(distance, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(distance, "TILE_BYTES", 40_000)
    monkeypatch.setattr(distance, "_mapped", _unmade)
    df = spark.createDataFrame([(int(n), v.tolist()) for n, v in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    every = distance.kernel(x, x, "manhattan")
    np.fill_diagonal(every, np.inf)
    want = {(ids[row], ids[other], rank + 1) for row in range(900) for rank, other in enumerate(np.lexsort((ids, every[row]))[:3])}
    assert set(values(distance.nearest(df, df, 3, "manhattan"), "a_id", "b_id", "rank")) == want
