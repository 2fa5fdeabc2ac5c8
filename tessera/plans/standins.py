"""The domain's tables read off star-schema tables, in Spark and as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASELINE, OUTCOME, LATER = 1997, 1998, 1999
FACTORS = {1997: 1.0, 1998: 1.0685946832951803, 1999: 1.1371893665903605}

CLAIMS_SQL = """claims AS (
  SELECT o.o_custkey AS enrolid, l.l_shipdate AS svcdate, l.l_extendedprice * (1 - l.l_discount) AS netpay,
         upper(p.p_type) AS dx1, p.p_brand AS dx2, CASE WHEN l.l_linenumber >= 4 THEN upper(p.p_type) END AS pdx,
         p.p_size AS procgrp, CASE WHEN l.l_returnflag = 'R' THEN 'RX' ELSE 'MED' END AS claim_type,
         p.p_brand AS thercls, l.l_quantity AS daysupp
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("enrolid"),
        F.col("l_shipdate").alias("svcdate"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("netpay"),
        F.upper("p_type").alias("dx1"),
        F.col("p_brand").alias("dx2"),
        F.when(F.col("l_linenumber") >= 4, F.upper("p_type")).alias("pdx"),
        F.col("p_size").alias("procgrp"),
        F.when(F.col("l_returnflag") == "R", "RX").otherwise("MED").alias("claim_type"),
        F.col("p_brand").alias("thercls"),
        F.col("l_quantity").alias("daysupp"),
    )


ENROLLMENT_SQL = """enrollment AS (
  SELECT c_custkey AS enrolid, c_mktsegment AS sex, r_name AS region, CAST(floor(c_acctbal / 2500) AS INT) AS agegrp, c_acctbal AS income
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("enrolid"), F.col("c_mktsegment").alias("sex"), F.col("r_name").alias("region"), F.floor(F.col("c_acctbal") / 2500).cast("int").alias("agegrp"), F.col("c_acctbal").alias("income"))


REDBOOK_SQL = "redbook AS (SELECT DISTINCT p_brand AS thercls, p_type AS thergrp FROM part)"


def redbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("thercls"), F.col("p_type").alias("thergrp")).distinct()


SCORED_SQL = "scored AS (SELECT event_id, user_id % 8 AS leaf, user_id % 5 AS leaf_b, CAST(event_type = 'purchase' AS INT) AS y, floor(value / 20) AS score, floor(value / 7) % 13 AS score_b FROM events)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 8).alias("leaf"),
        (F.col("user_id") % 5).alias("leaf_b"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        F.floor(F.col("value") / 20).cast("double").alias("score"),
        (F.floor(F.col("value") / 7) % 13).cast("double").alias("score_b"),
    )


VECTORS_SQL = "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label = 0 AS INT) AS target, label FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("label") == 0).cast("int").alias("target"), "label")
