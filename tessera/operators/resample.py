"""Neighbour-based resampling; ids stay in the plan, so no index has to be recovered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curate import undersample_to
from .distance import nearest


def near_miss(vectors: DataFrame, version: int = 1, k: int = 3, key="vec_id", target="target", metric="euclidean") -> DataFrame:
    """Ids of as many majority rows as there are minority rows.

    1: least mean distance to the k nearest minority rows; 2: to the k farthest; 3: of each minority
    row's k nearest, those of the largest mean distance.
    """
    minority, majority = vectors.where(F.col(target) == 1), vectors.where(F.col(target) == 0)
    n = minority.count()
    near = nearest(majority, minority, k, metric, key, False, farthest=version == 2)
    mean = near.groupBy("a_id").agg(F.avg("dist").alias("m"))
    if version == 3:
        pool = nearest(minority, majority, k, metric, key, False).select(F.col("b_id").alias("a_id")).distinct()
        mean = mean.join(pool, "a_id", "left_semi")
        return mean.orderBy(F.desc("m"), "a_id").limit(n).select(F.col("a_id").alias("id"))
    return mean.orderBy("m", "a_id").limit(n).select(F.col("a_id").alias("id"))


def tomek_links(vectors: DataFrame, key="vec_id", target="target", metric="euclidean") -> DataFrame:
    """Majority ids that are each other's nearest neighbour with a minority row."""
    one = nearest(vectors, vectors, 1, metric, key).select("a_id", "b_id")
    label = vectors.select(F.col(key).alias("id"), F.col(target).alias("y"))
    back = one.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    pairs = one.join(back, ["a_id", "b_id"]).join(label.withColumnsRenamed({"id": "a_id", "y": "ya"}), "a_id").join(label.withColumnsRenamed({"id": "b_id", "y": "yb"}), "b_id")
    return pairs.where("ya = 0 AND yb = 1").select(F.col("a_id").alias("id"))


def _neighbour_labels(vectors, k, key, target, metric) -> DataFrame:
    label = vectors.select(F.col(key).alias("id"), F.col(target).alias("y"))
    near = nearest(vectors, vectors, k, metric, key)
    return near.join(label.withColumnsRenamed({"id": "a_id", "y": "ya"}), "a_id").join(label.withColumnsRenamed({"id": "b_id", "y": "yb"}), "b_id")


def edited_out(vectors: DataFrame, k: int = 3, key="vec_id", target="target", metric="euclidean") -> DataFrame:
    """Majority ids with a neighbour of the other class among the k nearest (all have to agree)."""
    rows = _neighbour_labels(vectors, k, key, target, metric).where("ya = 0")
    return rows.groupBy("a_id").agg(F.max("yb").alias("m")).where("m = 1").select(F.col("a_id").alias("id"))


def cleaned_out(vectors: DataFrame, k: int = 3, key="vec_id", target="target", metric="euclidean") -> DataFrame:
    """Majority ids that their k neighbours outvote, and those near minority rows that theirs outvote."""
    rows = _neighbour_labels(vectors, k, key, target, metric)
    own = rows.groupBy("a_id", "ya").agg((2 * F.sum("yb") > F.count("*")).alias("votes_one"))
    out = own.where("ya = 0 AND votes_one").select(F.col("a_id").alias("id"))
    lost = own.where("ya = 1 AND NOT votes_one").select("a_id")
    near = rows.join(lost, "a_id", "left_semi").where("yb = 0").select(F.col("b_id").alias("id"))
    return out.unionByName(near).distinct()


def random_undersampled(df: DataFrame, target: str, key: str, seed: int) -> DataFrame:
    """All minority rows and as many majority rows."""
    n = df.where(F.col(target) == 1).count()
    return undersample_to(df, target, {0: n, 1: n}, key, seed)


def smote(vectors: DataFrame, n_new: int, k: int = 5, key="vec_id", target="target", metric="euclidean", seed: int = 0) -> DataFrame:
    """n_new synthetic minority rows: base_id, near_id, gap, v = base + gap * (neighbour - base).

    Every minority row stands in for as many new ones as it takes, the first n_new by hash are made;
    neighbours and gaps are drawn by hash as well.
    """
    minority = vectors.where(F.col(target) == 1).select(key, "v")
    n = minority.count()
    if not n:
        raise ValueError("no minority rows")
    near = nearest(minority, minority, k, metric, key).groupBy("a_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "b_id"))).alias("near"))
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col(key), F.col("copy"))
    new = minority.select(key, F.explode(F.sequence(F.lit(1), F.lit(-(-n_new // n)))).alias("copy")).orderBy(hashed(1), key, "copy").limit(n_new)
    new = new.join(near, F.col(key) == F.col("a_id"))
    new = new.withColumn("near_id", F.element_at("near", (F.pmod(hashed(2), F.size("near")) + 1).cast("int"))).withColumn("gap", F.pmod(hashed(3), F.lit(1_000_000)) / 1e6)
    base = minority.select(F.col(key).alias("base_id"), F.col("v").alias("a"))
    other = minority.select(F.col(key).alias("near_id"), F.col("v").alias("b"))
    rows = new.select(F.col(key).alias("base_id"), "copy", "near_id", "gap").join(base, "base_id").join(other, "near_id")
    return rows.select("base_id", "copy", "near_id", "gap", F.zip_with("a", "b", lambda x, y: x + F.col("gap") * (y - x)).alias("v"))
