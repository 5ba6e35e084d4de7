"""Stratified, patient-disjoint hold-outs and folds, ordered by hash instead of a random stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shuffled(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """With `place` (from 1) and `size` of each row within its stratum, by the md5 of seed and key.

    A stratum may hold nearly all rows, so places are the rows of all smaller digest
    ranges (4,096 a stratum) plus the place within the own range.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key)))
    rows = df.withColumn("__md5", digest).withColumn("__range", F.substring("__md5", 1, 3))
    before = W.partitionBy(stratum).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(stratum, "__range").agg(F.count("*").alias("__n"))
    bases = counts.select(F.col(stratum).alias("__s"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(W.partitionBy(stratum)).alias("size"))
    local = rows.withColumn("__k", F.row_number().over(W.partitionBy(stratum, "__range").orderBy("__md5", key)))
    joined = local.join(bases, local[stratum].eqNullSafe(bases["__s"]) & (local["__range"] == bases["__r"]))
    return joined.select(*df.columns, (F.col("__base") + F.col("__k")).alias("place"), "size")


def holdout(patients: DataFrame, key: str, label: str, ratio: float, seed: int) -> DataFrame:
    """(key, label, held): per class, round-half-even of the ratio, at least 1, at most all but 1."""
    n = F.least(F.col("size") - 1, F.greatest(F.lit(1), F.bround(F.col("size") * ratio)))
    return shuffled(patients.select(key, label), label, key, seed).select(key, label, (F.col("place") <= n).alias("held"))


def folds(patients: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """(key, label, fold): each class dealt to folds 0..k-1 in turn."""
    return shuffled(patients.select(key, label), label, key, seed).select(key, label, ((F.col("place") - 1) % k).cast("int").alias("fold"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first in the given total order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def balanced_sample(df: DataFrame, stratum: str, label: str, case: str, key: str, n: int) -> DataFrame:
    """The first n rows of each stratum, taking labels in turn and within a label its cases in turn."""
    # a row that is not among the first n of its case, or of its label, is not among the
    # first n of its stratum; each cut is pushed below its window's shuffle
    nth = F.row_number().over(W.partitionBy(stratum, label, case).orderBy(key))
    turn = F.row_number().over(W.partitionBy(stratum, label).orderBy("__nth", case))
    rank = F.row_number().over(W.partitionBy(stratum).orderBy("__turn", F.col(label).asc_nulls_last()))
    first = df.withColumn("__nth", nth).filter(F.col("__nth") <= n).withColumn("__turn", turn).filter(F.col("__turn") <= n)
    return first.withColumn("place", rank).filter(F.col("place") <= n).drop("__nth", "__turn")
