"""Splits, fitted preprocessing, Gower matrices, warps and embeddings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import column_roles


def hash_order(key: str, seed: int) -> list[Column]:
    """A fixed random order of ids: SHA-256 of seed and id, then the id; the same on any engine and partitioning."""
    return [F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), F.col(key)]


#: Leading hex digits of the hash that make a bucket; strata and cuts that are broadcast at most.
BUCKET_DIGITS, BROADCAST_CUTS = 3, 10_000


def hash_cuts(df: DataFrame, by: str, ranks: dict[str, Column], key: str, seed: int) -> DataFrame:
    """stratum, name, n, rank, h, id: of each stratum the row at each named rank of the hash order (null where the rank is 0 or less).

    ``ranks`` are expressions of n, the stratum's size.  Counts by hash bucket find the bucket that a
    rank falls into, and only those buckets' rows are ordered: no task holds a whole stratum.
    """
    order = hash_order(key, seed)
    keyed = df.select(F.col(by).alias("stratum"), F.col(key).alias("id"), order[0].alias("h"))
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    counts = keyed.groupBy("stratum", bucket.alias("b")).agg(F.count("*").alias("c"))
    run, whole = Window.partitionBy("stratum").orderBy("b"), Window.partitionBy("stratum")
    cum = counts.select("stratum", "b", "c", (F.sum("c").over(run) - F.col("c")).alias("start"), F.sum("c").over(whole).alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(rank.cast("bigint"), F.col("n")).alias("rank")) for name, rank in ranks.items())))
    wanted = cum.withColumn("x", named).select("stratum", "b", "c", "start", "n", "x.name", "x.rank")
    sizes = wanted.select("stratum", "name", "n", "rank").distinct()
    at = wanted.where("start < rank AND rank <= start + c")
    rows = keyed.withColumn("b2", bucket).join(F.broadcast(at) if at.count() <= BROADCAST_CUTS else at, (F.col("b2") == F.col("b")) & keyed["stratum"].eqNullSafe(at["stratum"]))
    place = F.row_number().over(Window.partitionBy(at["stratum"], "name", "b").orderBy("h", "id"))
    hit = rows.select(at["stratum"].alias("s"), F.col("name").alias("cut"), "h", "id", (F.col("start") + place).alias("place"), F.col("rank").alias("r")).where("place = r")
    return sizes.join(hit, sizes["stratum"].eqNullSafe(hit["s"]) & (sizes["name"] == hit["cut"]), "left").select("stratum", "name", "n", "rank", "h", "id")


def _below(df: DataFrame, by: str, ranks: dict[str, Column], key: str, seed: int) -> DataFrame:
    """``df`` with one boolean column a named rank: whether the row is among the stratum's first."""
    cuts = hash_cuts(df, by, ranks, key, seed).groupBy(F.col("stratum").alias("__s")).pivot("name", list(ranks)).agg(F.first(F.struct("h", "id")))
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_CUTS else cuts
    rows = df.withColumn("__h", hash_order(key, seed)[0]).join(cuts, F.col(by).eqNullSafe(F.col("__s")))
    test = lambda n: (F.col("__h") < F.col(f"`{n}`.h")) | ((F.col("__h") == F.col(f"`{n}`.h")) & (F.col(key) <= F.col(f"`{n}`.id")))
    return rows.select(*df.columns, *(F.coalesce(test(n), F.lit(False)).alias(n) for n in ranks))


def stratified_split(df: DataFrame, target: str, shares: Sequence[float] = (0.7, 0.15, 0.15), names: Sequence[str] = ("train", "val", "test"), key: str = "enrolid", seed: int = 0) -> DataFrame:
    """key, target, split: within each stratum ids in hash order are cut at round(n * share)."""
    ranks, done = {}, 0.0
    for share, name in zip(shares[:-1], names[:-1], strict=True):
        done += share
        ranks[f"__{name}"] = F.round(F.col("n") * F.lit(round(done, 9)))
    rows = _below(df.select(key, target), target, ranks, key, seed)
    chain = F.lit(names[-1])
    for name in reversed(names[:-1]):
        chain = F.when(F.col(f"__{name}"), name).otherwise(chain)
    return rows.select(key, target, chain.alias("split"))


def first_of_strata(df: DataFrame, by: str, sizes: dict, key: str, seed: int) -> DataFrame:
    """Of each stratum its first ``sizes[stratum]`` rows in hash order (all of a smaller one, none of one without a size)."""
    some = df.where(F.col(by).isin(list(sizes)))
    chain = F.coalesce(*(F.when(F.col("stratum") == v, n) for v, n in sizes.items()))
    return _below(some, by, {"__in": chain}, key, seed).where("__in").drop("__in")


def unique_ids(df: DataFrame, key: str) -> None:
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")


@dataclass
class Preprocessor:
    """Imputation, one-hot encoding (first category dropped, unknown ones all zero) and z-scores of population deviation."""

    key: str
    categorical: dict[str, tuple[str | None, list[str]]] = field(default_factory=dict)
    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    binary: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, key: str, roles: dict[str, list[str]] | None = None) -> Preprocessor:
        """All statistics of ``rows`` in one aggregate; which rows to fit on is the caller's choice."""
        roles = roles or column_roles(rows, key)
        out = cls(key, binary=list(roles.get("binary", ())))
        stats = []
        for c in roles.get("numeric", ()):
            x = F.col(c).cast("double")
            stats += [F.percentile(x, 0.5).alias(f"m:{c}"), F.count_if(x.isNull()).alias(f"z:{c}"), F.sum(x).alias(f"s:{c}"), F.sum(x * x).alias(f"q:{c}"), F.count("*").alias(f"n:{c}"), F.avg(x).alias(f"a:{c}"), F.var_pop(x).alias(f"v:{c}")]
        for c in roles.get("categorical", ()):
            stats += [F.mode(c, True).alias(f"mode:{c}"), F.count_if(F.col(c).isNull()).alias(f"z:{c}"), F.array_sort(F.collect_set(c)).alias(f"c:{c}")]
        row = rows.agg(*stats).first() if stats else {}
        for c in roles.get("numeric", ()):
            n, z, median = row[f"n:{c}"], row[f"z:{c}"], row[f"m:{c}"] or 0.0
            k = n - z  # imputed rows move mean and variance: combine the two groups
            mean = ((row[f"a:{c}"] or 0.0) * k + median * z) / n if n else 0.0
            var = (((row[f"v:{c}"] or 0.0) + ((row[f"a:{c}"] or 0.0) - mean) ** 2) * k + (median - mean) ** 2 * z) / n if n else 0.0
            out.numeric[c] = (median, mean, var**0.5 or 1.0)
        for c in roles.get("categorical", ()):
            out.categorical[c] = (row[f"mode:{c}"] if row[f"z:{c}"] else None, row[f"c:{c}"])
        return out

    def columns(self) -> dict[str, Column]:
        """Encoded columns by name: categories, numbers, flags."""
        out: dict[str, Column] = {}
        for c, (mode, values) in self.categorical.items():
            x = F.coalesce(F.col(c), F.lit(mode)) if mode is not None else F.col(c)
            out |= {f"{c}_{v}": F.coalesce((x == v).cast("double"), F.lit(0.0)) for v in values[1:]}
        for c, (median, mean, std) in self.numeric.items():
            out[c] = (F.coalesce(F.col(c).cast("double"), F.lit(median)) - mean) / std
        return out | {c: F.col(c).cast("double") for c in self.binary}

    def feature_names(self) -> list[str]:
        return list(self.columns())

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(self.key, *keep, *(x.alias(n) for n, x in self.columns().items()))

    def vectors(self, df: DataFrame, *keep: str) -> DataFrame:
        """key, keep and v, the encoded row as array<double>."""
        return df.select(self.key, *keep, F.array(*self.columns().values()).alias("v"))


@dataclass
class GowerSpace:
    """Binary flags, one-hot categories (first dropped) and numbers scaled to their range; nulls become 0 after scaling."""

    key: str
    binary: list[str]
    categories: dict[str, list[str]]
    ranges: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, rows: DataFrame, key: str, roles: dict[str, list[str]] | None = None) -> GowerSpace:
        roles = roles or column_roles(rows, key)
        stats = [F.array_sort(F.collect_set(c)).alias(f"c:{c}") for c in roles.get("categorical", ())]
        stats += [x for c in roles.get("numeric", ()) for x in (F.min(F.col(c).cast("double")).alias(f"lo:{c}"), F.max(F.col(c).cast("double")).alias(f"hi:{c}"))]
        row = rows.agg(*stats).first() if stats else {}
        ranges = {c: (row[f"lo:{c}"] or 0.0, ((row[f"hi:{c}"] or 0.0) - (row[f"lo:{c}"] or 0.0)) or 1.0) for c in roles.get("numeric", ())}
        return cls(key, list(roles.get("binary", ())), {c: row[f"c:{c}"] for c in roles.get("categorical", ())}, ranges)

    def vectors(self, df: DataFrame, *keep: str) -> DataFrame:
        """key, keep, b (binary and one-hot part) and v (scaled numbers), arrays of double."""
        zero = F.lit(0.0)
        flags = [F.coalesce(F.col(c).cast("double"), zero) for c in self.binary]
        flags += [F.coalesce((F.col(c) == x).cast("double"), zero) for c, values in self.categories.items() for x in values[1:]]
        numbers = [F.coalesce((F.col(c).cast("double") - lo) / r, zero) for c, (lo, r) in self.ranges.items()]
        empty = F.array().cast("array<double>")
        return df.select(self.key, *keep, (F.array(*flags) if flags else empty).alias("b"), (F.array(*numbers) if numbers else empty).alias("v"))


def warp_log_clip(df: DataFrame, columns: Sequence[str], fit_on: DataFrame, low: float = 0.02, high: float = 0.975, log=F.log10) -> DataFrame:
    """log(1 + max(x, 0)) clipped at two quantiles of ``fit_on``, less the median, over the interquartile range (1e-10 at least).

    Quantiles are of the logged values, clipped for median and range.
    """
    logged = {c: log(1 + F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in columns}
    ends = fit_on.agg(*(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias(c) for c, x in logged.items())).first()
    clip = {c: F.least(F.greatest(x, F.lit(ends[c][0])), F.lit(ends[c][1])) for c, x in logged.items()}
    mid = fit_on.agg(*(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c, x in clip.items())).first()
    return df.withColumns({c: (x - mid[c][1]) / max(mid[c][2] - mid[c][0], 1e-10) for c, x in clip.items()})


def warp_robust(df: DataFrame, columns: Sequence[str], fit_on: DataFrame, low: float = 0.02, high: float = 0.975) -> DataFrame:
    """Values clipped at two quantiles, less the median, over the interquartile range."""
    q = fit_on.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, (low, 0.25, 0.5, 0.75, high)))).alias(c) for c in columns)).first()
    return df.withColumns({c: (F.least(F.greatest(F.col(c).cast("double"), F.lit(q[c][0])), F.lit(q[c][4])) - q[c][2]) / max(q[c][3] - q[c][1], 1e-10) for c in columns})


def warp_z(df: DataFrame, columns: Sequence[str], fit_on: DataFrame) -> DataFrame:
    s = fit_on.agg(*(x for c in columns for x in (F.avg(c).alias(f"a:{c}"), F.stddev_pop(c).alias(f"s:{c}")))).first()
    return df.withColumns({c: (F.col(c) - s[f"a:{c}"]) / (s[f"s:{c}"] or 1.0) for c in columns})


def warp_rank(df: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Share of values at or below, clipped, less 0.5.

    Counts by distinct value are summed in score buckets, so ties agree and no task orders all values.
    """
    from .metrics import running

    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("score")).agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("pos"))
    share = running(n).select(F.col("score").alias("__x"), ((F.col("total_neg") - F.col("fp") + F.col("n")) / F.col("total_neg")).alias("__p"))
    ranked = df.join(share, F.col(column).cast("double") == F.col("__x"), "left").drop("__x")
    return ranked.withColumn(column, F.least(F.greatest(F.col("__p"), F.lit(low)), F.lit(high)) - 0.5).drop("__p")


def tfidf(df: DataFrame, key: str, term: str) -> DataFrame:
    """key, term, w: tf * (ln((n + 1) / (df + 1)) + 1), rows of unit length."""
    n = df.select(key).distinct().count()
    tf = df.groupBy(key, term).agg(F.count("*").alias("tf"))
    dfreq = tf.groupBy(term).agg((F.log((F.lit(n) + 1.0) / (F.count("*") + 1)) + 1).alias("idf"))
    w = tf.join(dfreq, term).withColumn("w", F.col("tf") * F.col("idf"))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(key, term, "w")


def truncated_svd(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """key, v: projections on the first k right singular vectors, from the Gram matrix of the (narrow) columns.

    The Gram matrix is summed by partition; only its p x p entries reach the driver.  Signs are fixed
    by making each vector's largest entry positive.
    """
    import numpy as np
    import pandas as pd

    width = vectors.select(F.size("v")).first()[0]

    def gram(batches):
        total = np.zeros((width, width))
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy())
                total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "x": total.ravel()})

    rows = vectors.select("v").mapInPandas(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((width, width))
    for r in rows:
        g[r["i"], r["j"]] = r["x"]
    values, basis = np.linalg.eigh(g)
    basis = basis[:, np.argsort(-values)[:k]]
    basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    sums = [F.aggregate(F.zip_with("v", F.array(*map(F.lit, map(float, basis[:, j]))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for j in range(basis.shape[1])]
    return vectors.select(key, F.array(*sums).alias("v"))
