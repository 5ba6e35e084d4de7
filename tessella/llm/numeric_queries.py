"""Problem 2: percentiles of tissue_fraction and focus_score per objective lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bisection import counts_at, exact_percentiles, readings
from tessella.plans.registry import Registry
from tessella.session import cut_lineage, read

REGISTRY = Registry()
query = REGISTRY.query

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
FIELDS = ["tissue_fraction", "focus_score"]
_LONG = """SELECT 'tissue_fraction' AS field, objective_lens, tissue_fraction AS v, processed_at FROM processing
UNION ALL SELECT 'focus_score', objective_lens, focus_score, processed_at FROM processing"""


_SQL = f"""
WITH r AS (SELECT field, objective_lens, v FROM ({_LONG}) WHERE v IS NOT NULL AND CAST(v AS VARCHAR) <> 'nan' AND v >= 0),
q AS (SELECT unnest({PROBS}::DOUBLE[]) AS q)
SELECT field, objective_lens, q.q AS q, count(*) AS n_values,
  round(CASE q.q {' '.join(f'WHEN {p} THEN quantile_cont(v, {p})' for p in PROBS)} END, 6) AS value, 0.0::DOUBLE AS max_error
FROM r, q GROUP BY field, objective_lens, q.q"""


@query("p2_percentiles", sql=_SQL)
def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of both fields per lens."""
    long = readings(read(spark, sf_dir, "processing"), "objective_lens", FIELDS)
    return exact_percentiles(long, PROBS).select("field", F.col("grp").alias("objective_lens"), "q", "n_values", F.round("value", 6).alias("value"), "max_error")


def _dated(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    rows = read(spark, sf_dir, "processing").withColumn(unit, F.to_date(F.date_trunc(unit, "processed_at")))
    return readings(rows, "objective_lens", FIELDS, unit)


@query("p2_combined", sql=_SQL)
def p2_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles from counts of each day of processed_at, added up in every pass."""
    found = exact_percentiles(_dated(spark, sf_dir, "day"), PROBS, by=("day",))
    return found.select("field", F.col("grp").alias("objective_lens"), "q", "n_values", F.round("value", 6).alias("value"), "max_error")


@query("p2_month_counts", sql=f"""
WITH r AS (SELECT field, objective_lens, v, CAST(date_trunc('month', processed_at) AS DATE) AS month FROM ({_LONG}) WHERE v IS NOT NULL AND CAST(v AS VARCHAR) <> 'nan' AND v >= 0),
q AS (SELECT unnest({PROBS}::DOUBLE[]) AS q),
p AS (SELECT field, objective_lens, q.q AS q, CASE q.q {' '.join(f'WHEN {p} THEN quantile_cont(v, {p})' for p in PROBS)} END AS value FROM r, q GROUP BY field, objective_lens, q.q)
SELECT month, field, objective_lens, q, round(value, 6) AS value, count(*) FILTER (v < value) AS n_below, count(*) FILTER (v <= value) AS n_upto, count(*) AS n_values
FROM r JOIN p USING (field) WHERE r.objective_lens IS NOT DISTINCT FROM p.objective_lens GROUP BY ALL""".replace("SELECT month, field, objective_lens, q,", "SELECT month, field, r.objective_lens AS objective_lens, q,"))
def p2_month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's counts below and up to the percentiles of all; counts of months add up."""
    long = _dated(spark, sf_dir, "month")
    return counts_at(long, cut_lineage(exact_percentiles(long, PROBS)), "month").withColumnRenamed("grp", "objective_lens").withColumn("value", F.round("value", 6))
