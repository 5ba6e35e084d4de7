"""Problem 7: the five best tiles of every patient."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identifiers import tidy_upper
from tessella.llm.topn import top_n
from tessella.plans.registry import Registry
from tessella.session import read

REGISTRY = Registry()
query = REGISTRY.query

#: Tiles kept of each patient.
N = 5


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "patient_level_cv").filter("y_prob >= 0 AND y_prob <= 1")
    return top_n(rows, tidy_upper("patient_id"), F.col("tile_path"), F.col("scored_at"), F.col("y_prob"), F.col("pred_no"), N)


_SQL = """
WITH v AS (SELECT upper(trim(patient_id)) AS patient_id, tile_path, y_prob, pred_no, scored_at FROM patient_level_cv
  WHERE trim(patient_id) <> '' AND y_prob IS NOT NULL AND NOT isnan(y_prob) AND y_prob BETWEEN 0 AND 1
  QUALIFY row_number() OVER (PARTITION BY upper(trim(patient_id)), tile_path ORDER BY scored_at DESC, pred_no) = 1),
b AS (SELECT patient_id, pred_no, row_number() OVER (PARTITION BY patient_id ORDER BY y_prob DESC, pred_no) AS place FROM v)"""


@query("p7_found", sql=_SQL + " SELECT patient_id, pred_no FROM b WHERE place <= 5")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up to five best tiles of each patient."""
    return _best(spark, sf_dir).select(F.col("grp").alias("patient_id"), F.col("id").alias("pred_no"))


@query("p7_ranked", sql=_SQL + " SELECT patient_id, pred_no, place FROM b WHERE place <= 5")
def p7_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with their places."""
    return _best(spark, sf_dir).select(F.col("grp").alias("patient_id"), F.col("id").alias("pred_no"), "place")
