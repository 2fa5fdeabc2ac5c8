"""Column typing, descriptions, correlations and feature selection."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame, key: str) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != key]


def binary_columns(df: DataFrame, columns: Sequence[str] | None = None, tolerance: float = 0.0) -> list[str]:
    """Columns whose non-null values are all 0 or 1 (within ``tolerance``), and not all null; one aggregate for all of them."""
    columns = list(numeric_columns(df) if columns is None else columns)
    if not columns:
        return []

    def fits(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.coalesce(F.bool_and((F.abs(x) <= tolerance) | (F.abs(x - 1) <= tolerance * 11)), F.lit(False)).alias(c)

    row = df.agg(*(fits(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def flag_columns(df: DataFrame, key: str, prefix: str = "has_") -> tuple[list[str], list[str]]:
    """Flag columns (named so or strictly binary), and those of them that are strictly binary."""
    numeric = [c for c in numeric_columns(df) if c != key]
    strict = binary_columns(df, numeric)
    return [c for c in numeric if c.startswith(prefix) or c in strict], strict


def column_roles(df: DataFrame, key: str) -> dict[str, list[str]]:
    flags, _ = flag_columns(df, key)
    cats = categorical_columns(df, key)
    return {"categorical": cats, "binary": flags, "numeric": [c for c in numeric_columns(df) if c not in flags and c != key]}


def roles_by_cardinality(df: DataFrame, key: str, most: int = 20) -> dict[str, list[str]]:
    """Binary columns and whole-numbered ones of under ``most`` values are categorical, the other numbers numeric."""
    numeric = [c for c in numeric_columns(df) if c != key]
    binary = set(binary_columns(df, numeric))
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType) and f.name in numeric]
    n = df.agg(*(F.approx_count_distinct(c).alias(c) for c in whole)).first() if whole else {}
    few = {c for c in whole if n[c] < most}
    cats = categorical_columns(df, key) + [c for c in numeric if c in binary or c in few]
    return {"categorical": cats, "numeric": [c for c in numeric if c not in cats]}


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, feature, value (double): one row a cell."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select(*keys, "x.feature", "x.value")


#: Bins of a histogram of values, and rows whose values are collected to read a quantile off.
BINS, READ = 4096, 100_000


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """The exact quantiles (linear interpolation; infinities and NaN come last as in Spark's order) of each column: histograms narrow them down to few values, which are read. The table is read a few times."""
    x = {c: F.col(c).cast("double") for c in columns}
    inf = float("inf")
    finite = {c: ~F.isnan(v) & (F.abs(v) < inf) for c, v in x.items()}
    ends = [f(c) for c in columns for f in (lambda c: F.count_if(finite[c]), lambda c: F.min(F.when(finite[c], x[c])), lambda c: F.max(F.when(finite[c], x[c])), lambda c: F.count_if(x[c] == -inf), lambda c: F.count_if(x[c] == inf), lambda c: F.count_if(F.isnan(x[c])))]
    row = df.agg(*(e.alias(f"e{i}") for i, e in enumerate(ends))).first()
    found, held, sizes = {}, {}, {}
    for k, c in enumerate(columns):
        n, low, high, n_low, n_high, n_nan = row[6 * k : 6 * k + 6]
        sizes[c] = n + n_low + n_high + n_nan
        for s in shares if sizes[c] else ():
            place = s * (sizes[c] - 1)
            for r in (math.floor(place), math.ceil(place)):
                if n_low <= r < n_low + n:
                    held[c, r] = (low, high, n_low, n)
                else:
                    found[c, r] = -inf if r < n_low else inf if r < n_low + n + n_high else math.nan
    while held:
        found |= {k: low for k, (low, high, _, _) in held.items() if low == high}
        held = {k: v for k, v in held.items() if k not in found}
        parts = sorted({(k[0], *v[:2], v[3] > READ) for k, v in held.items()})
        if not parts:
            break

        def spot(c, low, high, wide):
            bin_ = F.least(F.lit(BINS - 1.0), F.floor((x[c] / 2 - low / 2) / (high / 2 - low / 2) * BINS).cast("double"))
            return F.when(finite[c] & x[c].between(low, high), bin_ if wide else x[c])

        cells = F.array(*(F.struct(F.lit(i).alias("part"), spot(*p).alias("bin"), x[p[0]].alias("value")) for i, p in enumerate(parts)))
        rows = df.select(F.explode(cells).alias("x")).select("x.*").where("bin IS NOT NULL")
        got: list[list] = [[] for _ in parts]
        for b in rows.groupBy("part", "bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("part", "bin").collect():
            got[b["part"]].append(b)
        for (c, r), (low, high, before, n) in held.items():
            for b in got[parts.index((c, low, high, n > READ))]:
                if r < before + b["n"]:
                    break
                before += b["n"]
            held[c, r] = (b["low"], b["high"], before, b["n"])

    def at(c, place):
        a, b = found[c, math.floor(place)], found[c, math.ceil(place)]
        return a if a == b or place == math.floor(place) else a + (place - math.floor(place)) * (b - a)

    return {c: [at(c, s * (sizes[c] - 1)) if sizes[c] else None for s in shares] for c in columns}


def described(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """feature, n, mean, std, min, quantiles q<percent>, max; the columns are written once, since quantiles read them a few times."""
    from ..sources import writers

    spark, path, names = df.sparkSession, writers.scratch(df.sparkSession, "described"), [f"q{round(s * 100)}" for s in shares]
    writers.write_parquet(df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))), path)
    held = spark.read.parquet(path)
    q = quantiles(held, held.columns, shares)
    read = spark.createDataFrame([(c, *q[f"c{i}"]) for i, c in enumerate(columns)], ", ".join(["feature string", *(f"{n} double" for n in names)]))
    rows = long_form(held.withColumnsRenamed({f"c{i}": c for i, c in enumerate(columns)}), [], columns)
    out = rows.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.join(read, "feature").select("feature", "n", "mean", "std", "min", *names, "max")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, 0.5).alias("median"))


def target_correlations(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """feature, r: all correlations with the target in one aggregate."""
    y = F.col(target).cast("double")
    row = df.agg(*(F.corr(F.col(c).cast("double"), y).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns))).alias("x")).select("x.*")


def without_leaky(df: DataFrame, target: str, columns: Sequence[str], most: float, absolute: bool = True) -> list[str]:
    """Columns whose correlation with the target is ``most`` or less."""
    rows = target_correlations(df, target, columns).collect()
    return [r["feature"] for r in rows if r["r"] is None or (abs(r["r"]) if absolute else r["r"]) <= most]


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def pruned(df: DataFrame, columns: Sequence[str], score: dict[str, float], most: float = 0.95) -> list[str]:
    """Of two columns correlated at ``most`` or more, the one of lower score goes; greedy over the few columns, on the driver."""
    r = {(x["a"], x["b"]): x["r"] for x in pair_correlations(df, columns).collect()}
    kept: list[str] = []
    for c in sorted(columns, key=lambda c: (-score.get(c, 0.0), c)):
        if all(abs(r.get((c, k), r.get((k, c))) or 0.0) < most for k in kept):
            kept.append(c)
    return [c for c in columns if c in kept]


def binned_information(df: DataFrame, target: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """feature, mi: mutual information (nats) with a discrete target, values in equal-width bins."""
    rows = long_form(df, [target], columns).where("value IS NOT NULL")
    ends = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    spot = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    cells = rows.join(F.broadcast(ends) if len(columns) <= 10_000 else ends, "feature").groupBy("feature", spot.alias("bin"), F.col(target).alias("y")).agg(F.count("*").cast("double").alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    part = cells.select("feature", F.col("n"), by("bin").alias("nb"), by("y").alias("ny"), by().alias("nn"))
    return part.groupBy("feature").agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nb") * F.col("ny")))).alias("mi"))


def quota_selected(scores: DataFrame, quotas: dict[str, int], total: int, group="group", feature="feature", score="mi") -> DataFrame:
    """The best features of each group up to its quota, then the best of the rest, ``total`` in all."""
    rank = Window.partitionBy(group).orderBy(F.desc(score), feature)
    quota = F.coalesce(*(F.when(F.col(group) == g, n) for g, n in quotas.items()), F.lit(0))
    ranked = scores.withColumn("in_quota", F.row_number().over(rank) <= quota)
    return ranked.orderBy(F.desc("in_quota"), F.desc(score), feature).limit(total).select(group, feature, score)


def feature_group(name: str, rules: Sequence[tuple[str, str]], other: str = "other") -> str:
    """The group of the first rule (substring, group) that the name holds."""
    low = name.lower()
    return next((g for part, g in rules if part in low), other)


def without_year(columns: Sequence[str], years: Sequence[int]) -> list[str]:
    """Columns that name none of the outcome years."""
    return [c for c in columns if not any(str(y) in c for y in years)]


def feature_set(columns: Sequence[str], which: str) -> list[str]:
    """medical_only: no cost columns; less_cost: totals and shapes only; all_cost: everything."""
    cost = [c for c in columns if re.search(r"cost|pay", c, re.I)]
    if which == "all_cost":
        return list(columns)
    if which == "medical_only":
        return [c for c in columns if c not in cost]
    if which == "less_cost":
        return [c for c in columns if c not in cost or re.search(r"annual|total|pattern|stability", c, re.I)]
    raise ValueError(which)


def prevalence_delta(df: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """feature, mean_a (part = 1), mean_b (part = 0), delta."""
    mean = lambda v: F.avg(F.when(F.col(part) == v, F.col("value")))
    return long_form(df, [part], columns).groupBy("feature").agg(mean(1).alias("mean_a"), mean(0).alias("mean_b")).withColumn("delta", F.col("mean_a") - F.col("mean_b"))


def binary_target(df: DataFrame, column: str) -> DataFrame:
    """{-1, 1} as 0 and 1, {0, 1} as it is, any other two values with the rarer as 1 (ties: the larger)."""
    x = F.col(column)
    counts = {r[column]: r["count"] for r in df.where(x.isNotNull()).groupBy(column).count().limit(3).collect()}
    if len(counts) > 2:
        raise ValueError("more than two values")
    if set(counts) <= {0, 1}:
        one = 1
    elif set(counts) <= {-1, 1}:
        one = 1
    else:
        one = min(sorted(counts, reverse=True), key=counts.get)
    return df.withColumn(column, F.when(x == one, 1).when(x.isNotNull(), 0))


def set_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_a, n_b, n_both, n_only_a, n_only_b, jaccard of two id sets, in one aggregate."""
    both = a.select(key).distinct().withColumn("s", F.lit(1)).unionByName(b.select(key).distinct().withColumn("s", F.lit(2)))
    m = both.groupBy(key).agg(F.sum("s").alias("m"))
    n = lambda *v: F.count_if(F.col("m").isin(*v))
    return m.agg(n(1, 3).alias("n_a"), n(2, 3).alias("n_b"), n(3).alias("n_both"), n(1).alias("n_only_a"), n(2).alias("n_only_b"), F.try_divide(n(3).cast("double"), F.count("*")).alias("jaccard"))
