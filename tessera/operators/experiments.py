"""Runs built of the curation, model and metric operators."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import curate, metrics, models
from .distance import BLOCK_BYTES, TASK, _mapped, gower_kernel, pairwise
from .prepare import GowerSpace, Preprocessor
from .profile import long_form, set_relations

METRICS = ("euclidean", "manhattan", "chebyshev", "cosine", "jaccard", "hamming", "gower")


#: Numbers of a row up to which distances are expressions, flags that one integer holds, and rows alike that share a distance at most.
NUMBERS, FLAGS, ALIKE = 16, 62, 64


def gower_distances(space: GowerSpace, rows: DataFrame, others: DataFrame) -> DataFrame:
    """a_id, b_id, dist over mixed columns.

    Where a row has few numbers and one set is small enough to be broadcast, pairs are made by a join: flags are bits of integers,
    so that mismatches are counted at once, and a result of billions of rows takes no way through Python.  Rows alike share their
    distances and stand together in the result, which writers of columns then store in little room.  Otherwise both parts
    travel as one array, the binary one first.
    """
    key, n = space.key, len(space.binary) + sum(len(v) - 1 for v in space.categories.values())
    numbers, n_rows, n_others = len(space.ranges), rows.count(), others.count()
    width = -(-n // FLAGS)
    if numbers <= NUMBERS and min(n_rows, n_others) * 8 * (8 + width + numbers) <= BLOCK_BYTES:

        def flag(x):
            return F.when(x.isin(0.0, 1.0), x.cast("bigint")).otherwise(F.raise_error(F.lit("a binary column holds something other than 0 and 1")).cast("bigint"))

        def packed(df, side):
            flags = [reduce(lambda s, x: s + x, (F.shiftleft(flag(F.col("b")[j]), j - s) for j in range(s, min(s + FLAGS, n)))) for s in range(0, n, FLAGS)]
            rows = space.vectors(df).select(F.col(key).cast("bigint").alias("id"), *(x.alias(f"{side}_f{j}") for j, x in enumerate(flags)), *(F.col("v")[j].alias(f"{side}_n{j}") for j in range(numbers)))
            alike = [c for c in rows.columns if c != "id"]
            piece = F.floor((F.row_number().over(Window.partitionBy(*alike).orderBy("id")) - 1) / ALIKE)
            ids = F.transform(F.collect_list(F.struct("id")), lambda x: x["id"])  # nulls are kept
            return rows.withColumn("piece", piece).groupBy(*alike, "piece").agg(ids.alias(f"{side}_ids")).drop("piece")

        a, b = packed(rows, "a"), packed(others, "b")
        parts = max(1, min(2000, -(-n_rows * n_others // TASK)))
        if n_others <= n_rows:
            pairs, outer, inner = a.repartition(parts, "a_ids").crossJoin(F.broadcast(b)), "b", "a"
        else:
            pairs, outer, inner = b.repartition(parts, "b_ids").crossJoin(F.broadcast(a)), "a", "b"
        gaps = sum((F.abs(F.col(f"a_n{j}") - F.col(f"b_n{j}")) for j in range(numbers)), F.lit(0.0))
        differ = sum((F.bit_count(F.col(f"a_f{j}").bitwiseXOR(F.col(f"b_f{j}"))) for j in range(width)), F.lit(0))
        pairs = pairs.select("a_ids", "b_ids", ((gaps + differ) / F.lit(float(max(1, n + numbers)))).alias("dist"))
        for side in (outer, inner):
            pairs = pairs.withColumn(f"{side}_id", F.explode(f"{side}_ids")).drop(f"{side}_ids")
        return pairs.select("a_id", "b_id", "dist")

    whole = lambda df: space.vectors(df).select(key, F.concat("b", "v").alias("v"))

    def work(ids, m, block_ids, block):
        d = gower_kernel(m[:, :n], m[:, n:], block[:, :n], block[:, n:])
        return pd.DataFrame({"a_id": np.repeat(ids, len(block_ids)), "b_id": np.tile(block_ids, len(ids)), "dist": d.ravel()})

    return _mapped(whole(rows), whole(others), key, work, "a_id bigint, b_id bigint, dist double")


def distances_for(metric: str, rows: DataFrame, others: DataFrame, fit_on: DataFrame, roles: dict[str, list[str]], key: str) -> DataFrame:
    """Distances of raw rows by a named metric: gower over its own space, jaccard and hamming over the binary columns, the others over preprocessed columns."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if metric == "gower":
        return gower_distances(GowerSpace.fit(fit_on, key, roles), rows, others)
    if metric in ("jaccard", "hamming"):
        v = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in roles["binary"])).alias("v")
        return pairwise(rows.select(key, v), others.select(key, v), metric, key)
    prep = Preprocessor.fit(fit_on, key, roles)
    return pairwise(prep.vectors(rows), prep.vectors(others), metric, key)


def curated(vectors: DataFrame, key: str = "vec_id", target: str = "target", m: int | None = None, **how) -> dict:
    """A global curation run: candidates, matches, and why it was skipped (more cases than controls keep everything)."""
    n = {r[target]: r["count"] for r in vectors.groupBy(target).count().collect()}
    if n.get(1, 0) >= n.get(0, 0):
        every = vectors.where(F.col(target) == 0).select(F.col(key).alias("id"))
        return {"controls": every, "matches": None, "skipped_reason": "no more controls than cases"}
    candidates, matches = curate.two_stage(vectors, m or n[0] // 2, key=key, target=target, **how)
    return {"controls": matches.select(F.col("control_id").alias("id")).distinct(), "candidates": candidates, "matches": matches, "skipped_reason": None}


def disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if a.join(b.select(key), key, "left_semi").limit(1).count():
        raise ValueError("ids overlap")


def contained(part: DataFrame, whole: DataFrame, key: str) -> None:
    if part.join(whole.select(key), key, "left_anti").limit(1).count():
        raise ValueError("ids outside the whole")


def trained_and_evaluated(train: DataFrame, validation: DataFrame, test: DataFrame, columns: Sequence[str], target: str, key: str, kind: str = "tree", **params) -> dict:
    """A model fitted on ``train``, thresholds from ``validation``, rates on ``test``; ids must not meet."""
    disjoint(train, test, key)
    disjoint(train, validation, key)
    began = time.time()
    model = models.fit(train, columns, target, kind, **params)
    record = metrics.evaluation(models.predict(model, validation, columns), models.predict(model, test, columns), y=target)
    return record | {"model": model, "seconds": time.time() - began}


def ratio_sweep(cases: DataFrame, controls: DataFrame, ratios: Sequence[float], pick: Callable[[DataFrame, int], DataFrame], key: str) -> DataFrame:
    """ratio, id: for each ratio ceil(ratio * cases) controls by ``pick``, a prefix of one order where pick is."""
    n, out = cases.count(), None
    for r in ratios:
        part = pick(controls, math.ceil(r * n)).select(F.lit(float(r)).alias("ratio"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def pool_sweep(vectors: DataFrame, sizes: Sequence[int], key: str = "vec_id", target: str = "target", metric: str = "euclidean") -> DataFrame:
    """pool, mean_cost, q50, q90, n: matching costs for growing candidate pools; the greedy order is made once and its prefixes are used."""
    cases, controls = vectors.where(F.col(target) == 1), vectors.where(F.col(target) == 0)
    n = cases.count()
    if min(sizes) < n:
        raise ValueError(f"{n} cases need pools of {n} at least, not {min(sizes)}")
    order = curate.dispersed(controls, max(sizes), curate.seed_smart(controls, cases, metric, key), metric, key).select("id", "pick_order").collect()
    order = vectors.sparkSession.createDataFrame(order, "id bigint, pick_order bigint")
    out = None
    for m in sizes:
        pool = controls.join(order.where(F.col("pick_order") < m).select(F.col("id").alias(key)), key, "left_semi")
        part = curate.cost_summary(curate.matched_vectors(pool, cases, metric=metric, key=key)).select(F.lit(m).alias("pool"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def ablation(vectors_by_set: dict[str, DataFrame], m: int, key: str = "vec_id", target: str = "target", metric: str = "euclidean") -> DataFrame:
    """stage_a, stage_b, case_id, control_id, dist: controls dispersed in one feature set, matched in another, for all pairs of sets."""
    out = None
    for a, va in vectors_by_set.items():
        controls = va.where(F.col(target) == 0)
        picked = curate.dispersed(controls, m, curate.seed_smart(controls, va.where(F.col(target) == 1), metric, key), metric, key)
        ids = curate._kept(picked, "picks").select(F.col("id").alias(key))
        for b, vb in vectors_by_set.items():
            pool = curate._kept(vb.where(F.col(target) == 0).join(ids, key, "left_semi").select(key, "v"), "pool")
            part = curate.matched_vectors(pool, vb.where(F.col(target) == 1), metric=metric, key=key).select(F.lit(a).alias("stage_a"), F.lit(b).alias("stage_b"), "case_id", "control_id", "dist")
            out = part if out is None else out.unionByName(part)
    return out


def reevaluated(scored: DataFrame, targets: Sequence[str], score: str = "score") -> DataFrame:
    """target, auc, average_precision of saved scores for several targets: one unpivot, one plan."""
    rows = scored.select(score, F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y")) for t in targets))).alias("x")).select(F.col(score).alias("score"), "x.target", "x.y")
    r = metrics.running(metrics.score_counts(rows, by=["target"]), ["target"])
    return r.groupBy("target").agg(metrics.auc_column().alias("auc"), metrics.average_precision_column().alias("average_precision"))


def classifier_report(df: DataFrame, score: str = "score", y: str = "y", threshold: float | None = None) -> DataFrame:
    """auc, average_precision and the rates at the threshold of the best F1 (or the given one)."""
    t = metrics.best_f1(df, score, y).first()["threshold"] if threshold is None else threshold
    r = metrics.running(metrics.score_counts(df, score, y)).agg(metrics.auc_column().alias("auc"), metrics.average_precision_column().alias("average_precision"))
    return r.crossJoin(metrics.confusion(df, t, score, y).select(F.lit(t).alias("threshold"), "precision", "recall", "f1", "specificity"))  # one row each


def aligned(truth: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows whose id all three tables have."""
    return truth.join(a, key).join(b, key)


def aligned_by_place(a: DataFrame, b: DataFrame, order_a: Sequence[Column], order_b: Sequence[Column]) -> DataFrame:
    """Rows of two tables side by side by their place in an explicit order (for tables without ids; as long as the shorter)."""
    number = lambda df, o: df.withColumn("place", F.row_number().over(Window.orderBy(*o)) - 1)
    return number(a, order_a).join(number(b, order_b), "place")


def backfilled(df: DataFrame, other: DataFrame, column: str, key: str) -> DataFrame:
    """``column`` from a sibling table where ``df`` lacks it."""
    return df if column in df.columns else df.join(other.select(key, column), key, "left")


def refreshed(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Label columns replaced by those of ``labels``, 0 where an id has none."""
    new = [c for c in labels.columns if c != key]
    return df.drop(*new).join(labels, key, "left").na.fill(0, new)


def of_split(scored: DataFrame, split_ids: DataFrame, key: str, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """Predictions tagged with a split whose ids belong to that split."""
    return scored.where(F.col("split").isin(list(splits))).join(split_ids.select(key, "split"), [key, "split"], "left_semi")


def scaled_long(sets: dict[str, DataFrame], columns: Sequence[str], how: str = "standard") -> DataFrame:
    """set, feature, value: values scaled over the union of all sets, by mean and deviation or by rank ("quantile", normal scores)."""
    every = None
    for name, df in sets.items():
        part = long_form(df.withColumn("set", F.lit(name)), ["set"], columns).where("value IS NOT NULL")
        every = part if every is None else every.unionByName(part)
    if how == "standard":
        s = every.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
        return every.join(s, "feature").select("set", "feature", F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("s")), F.lit(0.0)).alias("value"))
    n = every.groupBy("feature", "value").agg(F.count("*").alias("n"))
    w, whole = Window.partitionBy("feature").orderBy("value"), Window.partitionBy("feature")
    share = (F.sum("n").over(w) - F.col("n") / 2) / F.sum("n").over(whole)
    return every.join(n.select("feature", "value", share.alias("p")), ["feature", "value"]).select("set", "feature", probit("p").alias("value"))


def probit(p: str | Column) -> Column:
    """The normal quantile of p, cut at 1e-7: a rational approximation (absolute error under 4.5e-4)."""
    c = F.least(F.greatest(F.col(p) if isinstance(p, str) else p, F.lit(1e-7)), F.lit(1 - 1e-7))
    t = F.sqrt(-2 * F.log(F.least(c, 1 - c)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(c < 0.5, -z).otherwise(z)


def cost_sets(df: DataFrame, sets: dict[str, DataFrame], cost: str, key: str) -> DataFrame:
    """set, n, mean, q25, median, q75 of a cost over chosen ids (column id)."""
    every = None
    for name, ids in sets.items():
        part = ids.select(F.col("id").alias(key), F.lit(name).alias("set"))
        every = part if every is None else every.unionByName(part)
    q = lambda p: F.percentile(cost, p)
    return every.join(df.select(key, cost), key).groupBy("set").agg(F.count("*").alias("n"), F.avg(cost).alias("mean"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return set_relations(a, b, key)


def nearest_mean(near: DataFrame, k: int) -> DataFrame:
    """a_id, mean distance of the k nearest (by rank) of a kNN table."""
    return near.where(F.col("rank") <= k).groupBy("a_id").agg(F.avg("dist").alias("mean_dist"))


def contribution_ratio(minority_majority: DataFrame, majority_majority: DataFrame) -> DataFrame:
    """feature, ratio of mean gaps between classes to those within the majority."""
    a, b = minority_majority.select("feature", F.col("mean_gap").alias("between")), majority_majority.select("feature", F.col("mean_gap").alias("within"))
    return a.join(b, "feature").withColumn("ratio", F.try_divide("between", "within"))


def stable_features(tops: Sequence[Sequence[str]]) -> float:
    """Mean Jaccard similarity of all pairs of top-feature lists."""
    from itertools import combinations

    from .reports import jaccard_of_tops

    pairs = [jaccard_of_tops(a, b) for a, b in combinations(tops, 2)]
    return sum(pairs) / len(pairs) if pairs else 1.0


def top_features(values: DataFrame, k: int) -> DataFrame:
    """class, feature, mean_abs: the k features of largest mean absolute attribution in each class of a long table (class, feature, value)."""
    m = values.groupBy("class", "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    w = Window.partitionBy("class").orderBy(F.desc("mean_abs"), "feature")
    return m.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def quarterly_stage(df: DataFrame, key: str, date: str, stage: Column) -> DataFrame:
    """key, quarter, max and mean stage, distinct months, claims with and without a stage: overlap counters in one aggregate."""
    s = df.select(key, F.quarter(date).alias("quarter"), F.month(date).alias("m"), stage.alias("s"))
    return s.groupBy(key, "quarter").agg(F.max("s").alias("max_stage"), F.avg("s").alias("mean_stage"), F.count_distinct("m").alias("months"), F.count("s").alias("n_staged"), F.count_if(F.col("s").isNull()).alias("n_unstaged"))
