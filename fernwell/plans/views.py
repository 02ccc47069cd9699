"""Feedback-shaped views over the driver's tables, in Spark; ``feedback_sql`` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwell.operators.analytics import Scale, month_of

SCALE = Scale()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fb_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a review: its nation the entity, priority, market segment and region the segments."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rating = F.when(key % 29 != 0, (1 + (key * 7 + cust * 3) % 5 - F.when((F.col("n_nationkey") % 4 == 0) & ((key * 7 + cust * 3) % 5 > 0) & (key % 3 == 0), 1).otherwise(0)).cast("double"))
    date = F.col("o_orderdate").cast("date")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
    return (
        joined.withColumn("rating", rating)
        .withColumn("sentiment", F.when(key % 31 == 0, F.lit(None)).otherwise(SCALE.sentiment(F.col("rating"))))
        .select(
            key.alias("review_id"), F.col("n_name").alias("entity"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"),
            "rating", "sentiment", date.alias("date"), month_of(date).alias("month"), F.col("o_totalprice").cast("double").alias("value"),
            F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.0).alias("fulfilled"),
            F.when(key % 13 == 0, F.lit(None)).otherwise((1 + key % 4).cast("double")).alias("weight"), (key % 10 != 0).alias("has_text"),
        )
    )


def fb_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
