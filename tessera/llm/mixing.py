"""Mixing sources to target weights.

Every row gets a hash-random key.  Sizes are summed by source and key bucket (a range of keys), prefix
sums over the buckets find the one bucket in which a source's budget ends, and only that bucket's rows
are ordered to find the key at the cut.  What the cut decides is then a comparison of each row's key
with its source's cut: no text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import n_inner, split_words
from .textkit import fresh, stored

#: Key buckets: 16 ** BUCKET_DIGITS.  Sources whose cuts are broadcast at most; more are joined by a shuffle.
BUCKET_DIGITS, BROADCAST_SOURCES = 3, 10_000


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, weight, source_size, target: the total shared by weight, no target above ``most`` times its source's size."""
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("r") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "r")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (
        capped.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("fits", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("open"))
        .withColumn("first", F.max(F.when(F.col("fits"), F.struct("open", "rest"))).over(every))
    )
    share = F.col("first.rest").cast("double") * F.col("weight") / F.col("first.open")
    over = F.col("first").isNull() | (F.col("cap") * F.col("first.open") < F.col("first.rest") * F.col("weight"))
    return left.select("source", "weight", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_cuts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row a source: source, source_size, target, epochs (whole passes), cut_key and cut_size (last row of the part pass)."""
    docs = docs.select("doc_id", "source", "text")
    sized = docs.select("source", _key(seed).alias("key"), n_inner(split_words(F.col("text"))).cast("bigint").alias("size"))
    sums = stored(sized.groupBy("source", F.substring("key", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("size")))
    targets = _targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    plan = (
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest")
    )
    plan = stored(plan)
    run = Window.partitionBy("s").orderBy("bucket")
    ends = sums.join(plan, F.expr("source <=> s")).withColumn("start", F.sum("size").over(run) - F.col("size"))
    cuts = ends.where("start <= rest").groupBy("s").agg(F.max_by(F.struct("bucket", "start"), "bucket").alias("at"))
    cuts = stored(plan.alias("p").join(cuts.alias("c"), F.expr("p.s <=> c.s"), "left").select("p.*", "at.bucket", "at.start"))
    few = cuts.count() <= BROADCAST_SOURCES
    near = F.broadcast(cuts) if few else cuts
    rows = docs.withColumn("key", _key(seed)).join(near, F.expr("source <=> s AND substring(key, 1, {0}) = bucket".format(BUCKET_DIGITS)))
    rows = rows.select("s", "start", "rest", "key", n_inner(split_words(F.col("text"))).cast("bigint").alias("size"))
    order = Window.partitionBy("s").orderBy("key", "size")
    rows = rows.withColumn("end", F.col("start") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    last = rows.where("2 * end - size <= 2 * rest").groupBy("s").agg(F.max(F.struct("key", "size")).alias("last"))
    return stored(
        cuts.alias("p")
        .join(last.alias("l"), F.expr("p.s <=> l.s"), "left")
        .selectExpr("p.s AS cut_source", "source_size", "target", "epochs", "coalesce(last.key, bucket, '') AS cut_key", "coalesce(last.size, 0L) AS cut_size")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes the whole row.

    Sources in code-point order, null last, take the weights in turn; the targets share the total of
    all sizes, none above ``most`` times its source.  Whole passes repeat a source; the part pass ends
    at the row whose middle is the last at or before the budget.  Null and empty texts have size 0.
    Rows alike in doc_id and size share their fate; a null doc_id is a key like any other.  Columns of
    ``docs`` with the added names are replaced.  An empty table gives an empty result.
    """
    cuts = mix_cuts(docs, weights, most, seed)
    near = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    key, of, total, goal, epochs, cut, last = fresh(own, "mix_key", "mix_of", "mix_total", "mix_target", "mix_epochs", "mix_cut", "mix_last")
    near = near.toDF(of, total, goal, epochs, cut, last)
    base = docs.select(*own, n_inner(split_words(F.col("text"))).cast("bigint").alias("size"), _key(seed).alias(key))
    part = (F.col(key) < F.col(cut)) | ((F.col(key) == F.col(cut)) & (F.col("size") <= F.col(last)))
    copies = F.least(F.lit(most), F.col(epochs) + part.cast("int"))
    return base.join(near, F.col("source").eqNullSafe(F.col(of))).select(*own, "size", F.col(total).alias("source_size"), F.col(goal).alias("target"), copies.alias("copies"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of the row, repeats counted)."""
    return mixed(docs.select("doc_id", "source", "text"), **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS r
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST((r - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT open AS f_open, rest AS f_rest FROM l WHERE rest * weight <= cap * open ORDER BY open DESC LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN f_open IS NULL OR cap * f_open < f_rest * weight THEN CAST(cap AS DOUBLE)
              ELSE CAST(f_rest AS DOUBLE) * weight / f_open END AS target
  FROM l LEFT JOIN f ON true
), p AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (epochs + CASE WHEN 2 * e - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
