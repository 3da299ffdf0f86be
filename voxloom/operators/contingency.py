"""Scores of clusters against labels from their contingency table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class ClusterScores:
    table: DataFrame  # cluster, label, n and totals
    clusters: DataFrame
    labels: DataFrame
    overall: DataFrame


def contingency(rows: DataFrame, cluster: str = "cluster_label", label: str = "primary_label") -> DataFrame:
    """n by cluster and label with both totals; null clusters and null or empty labels take no part."""
    kept = rows.select(F.col(cluster).alias("cluster"), F.col(label).cast("string").alias("label")).filter("cluster IS NOT NULL AND label <> ''")
    counts = kept.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return counts.select("*", F.sum("n").over(W.partitionBy("cluster")).alias("n_cluster"), F.sum("n").over(W.partitionBy("label")).alias("n_label"))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def score(rows: DataFrame, cluster: str = "cluster_label", label: str = "primary_label") -> ClusterScores:
    """Per cluster the majority label, per label the best cluster (ties: the lowest), and the overall scores.

    Purity of a cluster is its majority's share; mutual information and entropies use natural
    logarithms, and NMI divides by the labels' entropy. Without rows all overall scores are 0.
    """
    table = contingency(rows, cluster, label)
    p, r = F.col("n") / F.col("n_cluster"), F.col("n") / F.col("n_label")
    of_cluster = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "label"))
    clusters = table.withColumn("_k", of_cluster).filter("_k = 1")
    clusters = clusters.select("cluster", F.col("label").alias("majority_label"), F.col("n_cluster").alias("support"), F.col("n").alias("majority_count"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), p.alias("purity"))
    of_label = F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "cluster"))
    labels = table.withColumn("_k", of_label).filter("_k = 1")
    labels = labels.select("label", F.col("cluster").alias("best_cluster"), F.col("n_label").alias("support"), F.col("n").alias("best_count"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), r.alias("purity"))

    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
    share = F.col("n") / F.col("n_total")
    mutual = table.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(share * F.ln(F.col("n") * F.col("n_total") / (F.col("n_cluster") * F.col("n_label")))), F.lit(0.0)).alias("mutual_information"))
    part = F.col("support") / F.col("n_total")
    by_label = labels.crossJoin(F.broadcast(total)).agg(
        F.coalesce(-F.sum(part * F.ln(part)), F.lit(0.0)).alias("label_entropy"), F.coalesce(F.sum("best_count"), F.lit(0)).alias("_best"), F.count("*").alias("n_labels")
    )
    by_cluster = clusters.agg(
        F.coalesce(F.sum("majority_count"), F.lit(0)).alias("_major"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
        F.count("*").alias("n_clusters"),
    )
    one = total.crossJoin(mutual).crossJoin(by_label).crossJoin(by_cluster)  # one row each
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    overall = one.select(
        F.col("n_total").alias("n"), "n_clusters", "n_labels", ratio("_major", "n_total").alias("cluster_purity"), ratio("_best", "n_total").alias("label_purity"),
        "mutual_information", "label_entropy", ratio("mutual_information", "label_entropy").alias("nmi"), "macro_f1", "weighted_f1",
    )
    return ClusterScores(table, clusters.orderBy(F.desc("purity"), "cluster"), labels.orderBy(F.desc("purity"), "label"), overall)
