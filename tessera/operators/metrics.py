"""Metrics of scored rows by cumulative counts over distinct scores.

Rows are first summed to (group, score, n, pos).  Without groups the running sums over scores go in two
steps: totals of score buckets (their edges being approximate quantiles) are summed in order, then each
bucket on its own, so no task orders all distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def score_counts(df: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """by, score, n, pos: rows without a score or label are left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))


def running(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds tp and fp (rows at the score or above, by label), total_pos and total_neg, and the next lower and higher score."""
    if not by:
        edges = sorted(set(counts.approxQuantile("score", [i / BUCKETS for i in range(1, BUCKETS)], 0.005)))
        splits = [float("-inf"), *edges, float("inf")]
        counts = Bucketizer(splits=splits, inputCol="score", outputCol="__b").transform(counts) if len(splits) > 2 else counts.withColumn("__b", F.lit(0.0))
        totals = counts.groupBy("__b").agg(F.sum("pos").alias("bp"), F.sum(F.col("n") - F.col("pos")).alias("bn"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        w = Window.orderBy(F.desc("__b"))
        before, every = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
        totals = totals.select(
            F.col("__b").alias("__t"),
            F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("ap"),
            F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("an"),
            F.sum("bp").over(every).alias("total_pos"),
            F.sum("bn").over(every).alias("total_neg"),
            F.lag("lo").over(w).alias("above"),
            F.lead("hi").over(w).alias("below"),
        )
        counts = counts.join(F.broadcast(totals), F.col("__b") == F.col("__t"))  # BUCKETS rows at most
        own = Window.partitionBy("__b").orderBy(F.desc("score"))
        tp, fp = F.col("ap") + F.sum("pos").over(own), F.col("an") + F.sum(F.col("n") - F.col("pos")).over(own)
        lower, higher = F.coalesce(F.lead("score").over(own), F.col("below")), F.coalesce(F.lag("score").over(own), F.col("above"))
        return counts.select("score", "n", "pos", tp.alias("tp"), fp.alias("fp"), "total_pos", "total_neg", lower.alias("lower"), higher.alias("higher"))
    own, every = Window.partitionBy(*by).orderBy(F.desc("score")), Window.partitionBy(*by)
    neg = F.col("n") - F.col("pos")
    return counts.select(
        *by, "score", "n", "pos",
        F.sum("pos").over(own).alias("tp"), F.sum(neg).over(own).alias("fp"),
        F.sum("pos").over(every).alias("total_pos"), F.sum(neg).over(every).alias("total_neg"),
        F.lead("score").over(own).alias("lower"), F.lag("score").over(own).alias("higher"),
    )


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def auc_column() -> Column:
    """Over rows of :func:`running`: the chance that a positive scores above a negative, ties half; null with one class."""
    neg = F.col("n") - F.col("pos")
    won = F.sum(F.col("pos") * ((F.col("total_neg") - F.col("fp")) + neg / 2.0))
    return F.try_divide(won, F.max(F.col("total_pos") * F.col("total_neg")).cast("double"))


def average_precision_column() -> Column:
    return F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("total_pos").cast("double"))


def roc_auc(df: DataFrame, score="score", y="y", by: Sequence[str] = ()) -> DataFrame:
    return _grouped(running(score_counts(df, score, y, by), by), by).agg(auc_column().alias("auc"))


def average_precision(df: DataFrame, score="score", y="y", by: Sequence[str] = ()) -> DataFrame:
    return _grouped(running(score_counts(df, score, y, by), by), by).agg(average_precision_column().alias("average_precision"))


def _mcc(tp: Column, fp: Column, p: Column, n: Column) -> Column:
    tp, fp, p, n = (x.cast("double") for x in (tp, fp, p, n))
    fn, tn = p - tp, n - fp
    root = F.sqrt((tp + fp) * p * n * (tn + fn))
    return F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0)


def best_mcc(df: DataFrame, score="score", y="y", by: Sequence[str] = (), constant: str = "none", run: DataFrame | None = None) -> DataFrame:
    """threshold, mcc, recall, specificity at the midpoint between scores of the highest MCC, the lowest such; predicted is score >= threshold.

    With one score only all are predicted negative (threshold score + 1, mcc 0), or positive if
    ``constant`` is "all" (threshold score).  mcc is null with one class.
    """
    r = running(score_counts(df, score, y, by), by) if run is None else run
    cut = F.when(F.col("lower").isNull(), F.col("score") - 1e-12).otherwise((F.col("score") + F.col("lower")) / 2)
    at = r.select(*by, cut.alias("threshold"), "tp", "fp", "total_pos", "total_neg", "lower", "higher", "score")
    none = r.where("higher IS NULL").select(*by, (F.col("score") + 1e-12).alias("threshold"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"), "total_pos", "total_neg", "lower", "higher", "score")
    both = at.unionByName(none).withColumn("mcc", _mcc(F.col("tp"), F.col("fp"), F.col("total_pos"), F.col("total_neg")))
    best = _grouped(both, by).agg(F.max(F.struct("mcc", (-F.col("threshold")).alias("t"), "tp", "fp", "total_pos", "total_neg", (F.col("lower").isNull() & F.col("higher").isNull()).alias("one"), "score")).alias("b"))
    one = F.col("b.one")
    two = (F.col("b.total_pos") > 0) & (F.col("b.total_neg") > 0)
    alone = F.col("b.score") + (1.0 if constant == "none" else 0.0)
    hit = 0.0 if constant == "none" else 1.0
    return best.select(
        *by,
        F.when(one, alone).otherwise(-F.col("b.t")).alias("threshold"),
        F.when(two, F.when(one, 0.0).otherwise(F.col("b.mcc"))).alias("mcc"),
        F.when(one, hit).otherwise(F.try_divide(F.col("b.tp").cast("double"), F.col("b.total_pos"))).alias("recall"),
        F.when(one, 1 - hit).otherwise(1 - F.try_divide(F.col("b.fp").cast("double"), F.col("b.total_neg"))).alias("specificity"),
    )


def roc_points(df: DataFrame, score="score", y="y", by: Sequence[str] = (), drop_collinear: bool = True, run: DataFrame | None = None) -> DataFrame:
    """threshold, recall, specificity at each distinct score, optionally without points on a line between their neighbours."""
    r = running(score_counts(df, score, y, by), by) if run is None else run
    if drop_collinear:
        # the point above (higher score) and below differ by the counts of this score and the next lower one
        w = Window.partitionBy(*by).orderBy(F.desc("score")) if by else None
        if w is not None:
            next_pos, next_neg = F.lead("pos").over(w), F.lead(F.col("n") - F.col("pos")).over(w)
            r = r.withColumns({"np": next_pos, "nn": next_neg})
        else:
            c = r.select(F.col("score").alias("s2"), F.col("pos").alias("np"), (F.col("n") - F.col("pos")).alias("nn"))
            r = r.join(c, F.col("lower") == F.col("s2"), "left")
        neg = F.col("n") - F.col("pos")
        # scikit-style: the first score and the last stay; others where the step changes
        r = r.where(F.col("higher").isNull() | F.col("lower").isNull() | (F.col("np") != F.col("pos")) | (F.col("nn") != neg))
    return r.select(*by, F.col("score").alias("threshold"), F.try_divide(F.col("tp").cast("double"), "total_pos").alias("recall"), (1 - F.try_divide(F.col("fp").cast("double"), "total_neg")).alias("specificity"), "lower", "higher")


def best_balanced(df: DataFrame, score="score", y="y", by: Sequence[str] = (), side: str = "gmean", drop_collinear: bool = True, run: DataFrame | None = None) -> DataFrame:
    """threshold, value, recall, specificity of the highest geometric mean (or smaller side) of recall and specificity, the highest such.

    With one score: threshold score + 1, recall 0, specificity 1.
    """
    p = roc_points(df, score, y, by, drop_collinear, run)
    value = F.sqrt(F.col("recall") * F.col("specificity")) if side == "gmean" else F.least("recall", "specificity")
    best = _grouped(p.withColumn("value", value), by).agg(F.max(F.struct(F.round("value", 12).alias("v"), "threshold", "value", "recall", "specificity", (F.col("lower").isNull() & F.col("higher").isNull()).alias("one"))).alias("b"))
    one = F.col("b.one")
    pick = lambda c, alone: F.when(one, alone).otherwise(F.col(f"b.{c}")).alias(c)
    return best.select(*by, F.when(one, F.col("b.threshold") + 1).otherwise(F.col("b.threshold")).alias("threshold"), pick("value", 0.0), pick("recall", 0.0), pick("specificity", 1.0))


def recall_at_specificity(df: DataFrame, least: float, score="score", y="y", by: Sequence[str] = (), lowest: bool = False, run: DataFrame | None = None) -> DataFrame:
    """threshold, recall, specificity of the highest recall with specificity ``least`` or more (the highest threshold, or the ``lowest``); without one that of the highest specificity."""
    p = roc_points(df, score, y, by, False, run)
    t = -F.col("threshold") if lowest else F.col("threshold")
    feasible = (F.col("specificity") >= least).cast("int")
    rank = F.struct(feasible.alias("f"), F.when(feasible == 1, F.col("recall")).otherwise(F.col("specificity")).alias("r"), t.alias("t"), "threshold", "recall", "specificity", (F.col("lower").isNull() & F.col("higher").isNull()).alias("one"))
    best = _grouped(p, by).agg(F.max(rank).alias("b"))
    one = F.col("b.one")
    return best.select(*by, F.when(one, F.col("b.threshold") + 1).otherwise(F.col("b.threshold")).alias("threshold"), F.when(one, 0.0).otherwise(F.col("b.recall")).alias("recall"), F.when(one, 1.0).otherwise(F.col("b.specificity")).alias("specificity"))


def best_f1(df: DataFrame, score="score", y="y", by: Sequence[str] = (), run: DataFrame | None = None) -> DataFrame:
    """threshold, f1, precision, recall: 2PR / (P + R + 1e-10) at its highest, the lowest threshold of such."""
    r = running(score_counts(df, score, y, by), by) if run is None else run
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), "total_pos")
    f1 = 2 * precision * recall / (precision + recall + 1e-10)
    best = _grouped(r.withColumns({"precision": precision, "recall": recall, "f1": f1}), by).agg(F.max(F.struct("f1", (-F.col("score")).alias("t"), "precision", "recall")).alias("b"))
    return best.select(*by, (-F.col("b.t")).alias("threshold"), "b.f1", "b.precision", "b.recall")


def confusion(df: DataFrame, threshold: float | Column, score="score", y="y", by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn and the rates that follow; undefined rates are 0."""
    hit, one = F.col(score) >= threshold, F.col(y) == 1
    n = _grouped(df.where(F.col(score).isNotNull() & F.col(y).isNotNull()), by).agg(F.count_if(hit & one).alias("tp"), F.count_if(hit & ~one).alias("fp"), F.count_if(~hit & ~one).alias("tn"), F.count_if(~hit & one).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    n = n.withColumns({"recall": rate("tp", "fn"), "specificity": rate("tn", "fp"), "precision": rate("tp", "fp")})
    return n.withColumns({"f1": F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "mcc": _mcc(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn"))})


def evaluation(validation: DataFrame, test: DataFrame, score="score", y="y", specificity: float = 0.6) -> dict[str, float | None]:
    """The evaluation record: thresholds chosen on ``validation``, rates on ``test``.

    Both tables are read once: the cumulative counts by score of the first are kept while the
    thresholds are chosen, and one aggregate over those of the second gives all its rates.
    """
    from pyspark import StorageLevel

    ranking = (auc_column().alias("auc"), average_precision_column().alias("ap"))
    counts = score_counts(validation, score, y).persist(StorageLevel.MEMORY_AND_DISK)
    val = running(counts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        r = val.agg(*ranking).first()
        out: dict[str, float | None] = {"val_auc": r["auc"], "val_pr_auc": r["ap"]}
        picks = {
            "mcc": best_mcc(validation, run=val),
            "gmean": best_balanced(validation, run=val),
            "min_side": best_balanced(validation, side="min", run=val),
            "f1": best_f1(validation, run=val),
            "spec": recall_at_specificity(validation, specificity, run=val),
        }
        every = None
        for name, pick in picks.items():
            part = pick.select(F.lit(name).alias("name"), "threshold")
            every = part if every is None else every.unionByName(part)
        cuts = {r["name"]: r["threshold"] for r in every.collect()}
    finally:
        val.unpersist()
        counts.unpersist()
    known = {k: v for k, v in cuts.items() if v is not None}
    hits = [x for k, t in known.items() for x in (F.coalesce(F.sum(F.when(F.col("score") >= t, F.col("pos"))), F.lit(0)).alias(f"tp_{k}"), F.coalesce(F.sum(F.when(F.col("score") >= t, F.col("n") - F.col("pos"))), F.lit(0)).alias(f"fp_{k}"))]
    r = running(score_counts(test, score, y)).agg(*ranking, F.max("total_pos").alias("p"), F.max("total_neg").alias("q"), *hits).first()
    out |= {"test_auc": r["auc"], "test_pr_auc": r["ap"]}
    rate = lambda a, b: a / b if b else 0.0
    for k in cuts:
        out[f"threshold_{k}"] = cuts[k]
        if k in known and r["p"] is not None:
            tp, fp, p, q = r[f"tp_{k}"], r[f"fp_{k}"], r["p"], r["q"]
            recall, precision, root = rate(tp, p), rate(tp, tp + fp), ((tp + fp) * p * q * (q - fp + p - tp)) ** 0.5
            out |= {f"recall_{k}": recall, f"specificity_{k}": rate(q - fp, q), f"precision_{k}": precision, f"f1_{k}": rate(2 * precision * recall, precision + recall), f"mcc_{k}": rate(tp * (q - fp) - fp * (p - tp), root)}
    return out


# -- leaves ---------------------------------------------------------------------------------------


def leaf_rates(df: DataFrame, leaf="leaf", y="y") -> DataFrame:
    return df.groupBy(leaf).agg(F.count("*").alias("n"), F.sum(y).alias("positives"), F.avg(F.col(y).cast("double")).alias("rate"))


def refit_scores(fit: DataFrame, rows: DataFrame, leaf="leaf", y="y", fallback: float | None = None) -> DataFrame:
    """``rows`` with refit_score, the rate of their leaf in ``fit``; an unknown leaf takes the rate of all of ``fit`` (or ``fallback``)."""
    total = fit.agg(F.avg(F.col(y).cast("double"))).first()[0] if fallback is None else fallback
    rates = fit.groupBy(leaf).agg(F.avg(F.col(y).cast("double")).alias("refit_score"))
    return rows.join(rates, leaf, "left").withColumn("refit_score", F.coalesce("refit_score", F.lit(total)))


def excess_by_leaf(df: DataFrame, leaf="leaf", score="score", y="y", least: int = 10) -> DataFrame:
    """leaf, n, pos, neg, auc, informative (``least`` of either class or more) and the inverse-variance weight."""
    r = running(score_counts(df, score, y, [leaf]), [leaf])
    g = r.groupBy(leaf).agg(F.sum("n").alias("n"), F.max("total_pos").alias("pos"), F.max("total_neg").alias("neg"), auc_column().alias("auc"))
    rate = F.col("pos") / F.col("n")
    return g.withColumns({"informative": (F.col("pos") >= least) & (F.col("neg") >= least), "inverse_variance": 1 / (rate * (1 - rate) / F.col("n") + 1e-12)})


def weighted_excess_auc(df: DataFrame, leaf="leaf", score="score", y="y", least: int = 10, weight: str = "n") -> DataFrame:
    """excess (weighted mean of auc - 0.5 over informative leaves), n_leaves and coverage (share of rows in them)."""
    g = excess_by_leaf(df, leaf, score, y, least)
    w = F.when(F.col("informative"), F.col("n" if weight == "n" else "inverse_variance").cast("double"))
    return g.agg(F.try_divide(F.sum(w * (F.col("auc") - 0.5)), F.sum(w)).alias("excess"), F.count_if("informative").alias("n_leaves"), F.try_divide(F.sum(F.when(F.col("informative"), F.col("n"))).cast("double"), F.sum("n")).alias("coverage"))


def symmetric_excess(df: DataFrame, score_a: str, leaf_a: str, score_b: str, leaf_b: str, y="y", least: int = 10) -> DataFrame:
    """a_in_b and b_in_a (excess of one model's scores within the other's leaves), their mean and gap, and coverages."""
    a = weighted_excess_auc(df, leaf_b, score_a, y, least).select(F.col("excess").alias("a_in_b"), F.col("coverage").alias("coverage_b"))
    b = weighted_excess_auc(df, leaf_a, score_b, y, least).select(F.col("excess").alias("b_in_a"), F.col("coverage").alias("coverage_a"))
    both = a.crossJoin(b)  # one row each
    mean = F.coalesce((F.col("a_in_b") + F.col("b_in_a")) / 2, "a_in_b", "b_in_a")
    return both.select("*", mean.alias("symmetric"), (F.col("a_in_b") - F.col("b_in_a")).alias("gap"))


def bootstrap_excess(df: DataFrame, leaf="leaf", score="score", y="y", replicates: int = 2000, alpha: float = 0.05, seed: int = 42, least: int = 10) -> DataFrame:
    """estimate, low, high, p_greater (share of replicates at or below 0) of the weighted excess AUC.

    Rows are summed to (leaf, score, y) cells, a size that does not grow with the rows where scores are
    few; a replicate is a multinomial draw over the cells, like one over rows.  Replicates are dealt
    out in blocks over tasks, each with its own seed.
    """
    import numpy as np
    import pandas as pd

    cells = df.groupBy(F.col(leaf).alias("leaf"), F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("y")).agg(F.count("*").alias("n"))
    if cells.count() > 1_000_000:
        raise ValueError("too many distinct scores for the bootstrap; round them first")
    rows = cells.orderBy("leaf", "score", "y").toPandas()
    sent = df.sparkSession.sparkContext.broadcast(rows)

    def excess(frame: pd.DataFrame, n: np.ndarray) -> float:
        total = weight = 0.0
        for _, part in frame.assign(n=n).groupby("leaf"):
            pos, neg = part.n * part.y, part.n * (1 - part.y)
            p, q = pos.sum(), neg.sum()
            if p >= least and q >= least:
                g = pd.DataFrame({"s": part.score, "p": pos, "q": neg}).groupby("s").sum().sort_index()
                below = g.q.cumsum() - g.q
                auc = (g.p * (below + g.q / 2)).sum() / (p * q)
                total, weight = total + (p + q) * (auc - 0.5), weight + p + q
        return total / weight if weight else float("nan")

    def run(batches):
        frame = sent.value
        n = frame.n.to_numpy()
        for b in batches:
            out = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                out.append(excess(frame, n if i == 0 else rng.multinomial(n.sum(), n / n.sum())))
            yield pd.DataFrame({"id": b["id"], "excess": out})

    draws = df.sparkSession.range(0, replicates + 1, 1, 16).mapInPandas(run, "id bigint, excess double")
    ok = F.when((F.col("id") > 0) & ~F.isnan("excess"), F.col("excess"))
    return draws.agg(F.max(F.when(F.col("id") == 0, F.col("excess"))).alias("estimate"), F.percentile(ok, alpha / 2).alias("low"), F.percentile(ok, 1 - alpha / 2).alias("high"), F.avg((ok <= 0).cast("double")).alias("p_greater"))


def bootstrap_scores(df: DataFrame, scores: Sequence[str], y="y", replicates: int = 2000, alpha: float = 0.05, seed: int = 42, most: int = 1_000_000) -> DataFrame:
    """measure, estimate, low, high, p_greater, p_two_sided of the AUC and the average precision of one score, or of the difference of two.

    Rows are summed to cells of equal scores and label; a replicate is a multinomial draw over the cells.
    Replicates of one class are left out.  p_greater is the share of replicates at or below 0.
    """
    import numpy as np
    import pandas as pd

    cells = df.groupBy(*(F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores)), F.col(y).cast("int").alias("y")).agg(F.count("*").alias("n")).na.drop()
    if cells.count() > most:
        raise ValueError("too many distinct scores for the bootstrap; round them first")
    frame = cells.orderBy(*cells.columns).toPandas()
    sent = df.sparkSession.sparkContext.broadcast(frame)

    def both(score: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, float]:
        value, at = np.unique(score, return_inverse=True)
        pos, neg = np.bincount(at, n * label, len(value)), np.bincount(at, n * (1 - label), len(value))
        if not pos.sum() or not neg.sum():
            return float("nan"), float("nan")
        auc = (pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum())
        tp, fp = np.cumsum(pos[::-1])[::-1], np.cumsum(neg[::-1])[::-1]
        return auc, (pos * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0)).sum() / pos.sum()

    def run(batches):
        f = sent.value
        n, label = f.n.to_numpy(), f.y.to_numpy()
        for b in batches:
            out = []
            for i in b["id"]:
                draw = n if i == 0 else np.random.default_rng([seed, int(i)]).multinomial(n.sum(), n / n.sum())
                got = [both(f[f"s{k}"].to_numpy(), label, draw) for k in range(len(scores))]
                out.append(np.subtract(got[0], got[1]) if len(got) == 2 else got[0])
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), 2), "measure": ["auc", "average_precision"] * len(b), "v": np.ravel(out)})

    draws = df.sparkSession.range(0, replicates + 1, 1, 16).mapInPandas(run, "id bigint, measure string, v double")
    ok = F.when((F.col("id") > 0) & ~F.isnan("v"), F.col("v"))
    below, above = F.avg((ok <= 0).cast("double")), F.avg((ok >= 0).cast("double"))
    return draws.groupBy("measure").agg(
        F.max(F.when(F.col("id") == 0, F.col("v"))).alias("estimate"), F.percentile(ok, alpha / 2).alias("low"), F.percentile(ok, 1 - alpha / 2).alias("high"),
        below.alias("p_greater"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_two_sided"),
    )


# -- hardness and gating ----------------------------------------------------------------------------


def hardness(near_minority: DataFrame, near_majority: DataFrame) -> DataFrame:
    """id, d_min, d_maj, ratio, margin, minority_share and composite from two kNN tables (a_id, dist) to either class.

    The composite weighs the parts .33, .33, .34 after scaling each by its maximum.
    """
    a = near_minority.groupBy("a_id").agg(F.avg("dist").alias("d_min"), F.collect_list("dist").alias("x"))
    b = near_majority.groupBy("a_id").agg(F.avg("dist").alias("d_maj"), F.collect_list("dist").alias("y"))
    both = a.join(b, "a_id")
    k = F.size("x")
    nearest_k = F.slice(F.array_sort(F.concat(F.transform("x", lambda d: F.struct(d.alias("d"), F.lit(1).alias("m"))), F.transform("y", lambda d: F.struct(d.alias("d"), F.lit(0).alias("m"))))), F.lit(1), k)
    share = F.aggregate(nearest_k, F.lit(0.0), lambda s, v: s + v["m"]) / k
    out = both.select(F.col("a_id").alias("id"), "d_min", "d_maj", F.try_divide("d_maj", F.col("d_min") + 1e-12).alias("ratio"), (F.col("d_maj") - F.col("d_min")).alias("margin"), share.alias("minority_share"))
    parts = ("ratio", "margin", "minority_share")
    most = F.broadcast(out.agg(*(F.max(c).alias(f"__{c}") for c in parts)))  # one row
    top = lambda c: F.coalesce(F.try_divide(F.col(c), F.col(f"__{c}")), F.lit(0.0))
    composite = 0.33 * top("ratio") + 0.33 * top("margin") + 0.34 * top("minority_share")
    return out.crossJoin(most).withColumn("composite", composite).drop(*(f"__{c}" for c in parts))


def hard_subset(df: DataFrame, percent: float, hardness_column: str = "composite", target: str = "y") -> DataFrame:
    """All minority rows and the majority rows in the hardest ``percent``."""
    cut = df.where(F.col(target) == 0).agg(F.percentile(hardness_column, 1 - percent / 100)).first()[0]
    return df.where((F.col(target) == 1) | (F.col(hardness_column) >= F.lit(cut)))


def calibrated(fit: DataFrame, rows: DataFrame, score="score", y="y", out="calibrated") -> DataFrame:
    """Isotonic calibration fitted on ``fit``, clipped to [1e-6, 1 - 1e-6]."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    vector = VectorAssembler(inputCols=[score], outputCol="__f")
    model = IsotonicRegression(featuresCol="__f", labelCol="__y", predictionCol=out).fit(vector.transform(fit.withColumn("__y", F.col(y).cast("double"))))
    return model.transform(vector.transform(rows)).drop("__f").withColumn(out, F.least(F.greatest(out, F.lit(1e-6)), F.lit(1 - 1e-6)))


def gated(df: DataFrame, gate: str, cut: float, inside: str, outside: str, out: str = "hybrid") -> DataFrame:
    return df.withColumn(out, F.when(F.col(gate) >= F.lit(cut), F.col(inside)).otherwise(F.col(outside)))


def best_gate(validation: DataFrame, gate: str, inside: str, outside: str, percents: Sequence[float] = (50, 40, 30, 20, 15, 10, 5, 2), y="y") -> tuple[float, float]:
    """(percent, cut) of the gate of the best validation AUC, to be frozen for the test rows; all gates in one aggregate plan."""
    cuts = validation.agg(F.percentile(gate, F.array(*(F.lit(1 - p / 100) for p in percents)))).first()[0]
    parts = [gated(validation, gate, c, inside, outside).select(F.lit(float(p)).alias("percent"), F.col("hybrid").alias("score"), F.col(y).alias("y")) for p, c in zip(percents, cuts, strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = roc_auc(every, by=["percent"]).orderBy(F.desc("auc"), F.desc("percent")).first()
    return best["percent"], cuts[[float(p) for p in percents].index(best["percent"])]
