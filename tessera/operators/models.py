"""Models behind one interface.

Greedy trees of Spark ML stand in for the proprietary optimal ones, gradient-boosted trees for other
boosting libraries; they are substitutes, not equivalents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curate import grid
from .metrics import average_precision, roc_auc

KINDS = {"tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "boosted": GBTClassifier, "logistic": LogisticRegression}


def balanced(df: DataFrame, target: str) -> DataFrame:
    """With column weight: n / (2 n_class)."""
    n = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    total = sum(n.values())
    return df.withColumn("weight", F.coalesce(*(F.when(F.col(target) == c, total / (2.0 * k)) for c, k in n.items())))


def fit(df: DataFrame, columns: Sequence[str], target: str, kind: str = "tree", weighted: bool = False, **params):
    """A fitted model of one of KINDS; ``df`` is cached while it is read over and over."""
    vector = VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="keep")
    rows = vector.transform(balanced(df, target) if weighted else df).withColumn("__y", F.col(target).cast("double"))
    rows = rows.select("__x", "__y", *(["weight"] if weighted else [])).persist()
    try:
        return KINDS[kind](featuresCol="__x", labelCol="__y", predictionCol="predicted", **({"weightCol": "weight"} if weighted else {}), **params).fit(rows)
    finally:
        rows.unpersist()


def predict(model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with score and, for trees, leaf."""
    vector = VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="keep")
    tree = hasattr(model, "depth") and not hasattr(model, "trees")
    if tree:
        model.setLeafCol("leaf")
    out = model.transform(vector.transform(df)).withColumn("score", vector_to_array("probability")[1])
    return out.drop("__x", "rawPrediction", "probability", "predicted")


def tuned(train: DataFrame, validation: DataFrame, columns: Sequence[str], target: str, kind: str = "tree", **options: Sequence) -> tuple[object, list[dict]]:
    """The model of the best validation average precision over a parameter grid, and all results."""
    best, results = None, []
    for params in grid(**options):
        config = params.pop("config")
        model = fit(train, columns, target, kind, **params)
        scored = predict(model, validation, columns)
        ap = average_precision(scored, y=target).first()[0]
        results.append(params | {"config": config, "pr_auc": ap, "auc": roc_auc(scored, y=target).first()[0]})
        if best is None or (ap or 0) > best[0]:
            best = (ap or 0, model)
    return best[1], results


def importances(model, columns: Sequence[str], top: int = 20) -> list[tuple[str, float]]:
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    return sorted(zip(columns, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:top]


def permutation_importance(model, df: DataFrame, columns: Sequence[str], target: str, seed: int = 0) -> list[tuple[str, float]]:
    """Loss of AUC when one column's values are dealt out anew (by joining row places of two hash orders)."""
    from pyspark.sql import Window

    base = roc_auc(predict(model, df, columns), y=target).first()[0]
    placed = df.withColumn("__i", F.row_number().over(Window.orderBy(F.xxhash64(*columns), *columns)))
    out = []
    for c in columns:
        dealt = placed.select(F.col(c).alias("__v"), F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "__i"), "__i")).alias("__i"))
        rows = placed.drop(c).join(dealt, "__i").withColumnRenamed("__v", c)
        out.append((c, base - roc_auc(predict(model, rows, columns), y=target).first()[0]))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def tree_splits(model, columns: Sequence[str]) -> list[dict]:
    """path, feature, op, threshold of every split, read off the model's text."""
    import re

    out, path = [], []
    for line in model.toDebugString.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)", line)
        if m:
            depth = len(m[1]) // 1
            while path and path[-1][0] >= depth:
                path.pop()
            if m[2] == "If":
                out.append({"path": "".join(p for _, p in path) or "root", "feature": columns[int(m[3])], "op": m[4], "threshold": float(m[5])})
            path.append((depth, "L" if m[2] == "If" else "R"))
    return out


def binarised_at_median(df: DataFrame, columns: Sequence[str], fit_on: DataFrame) -> DataFrame:
    row = fit_on.agg(*(F.percentile(c, 0.5).alias(c) for c in columns)).first()
    return df.withColumns({c: (F.col(c) > F.lit(row[c])).cast("int") for c in columns})


def leaf_count(scored: DataFrame, leaf: str = "leaf") -> DataFrame:
    return scored.agg(F.count_distinct(leaf).alias("n_leaves"))
