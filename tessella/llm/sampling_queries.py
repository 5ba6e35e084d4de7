"""Problem 3: a sample of images with target shares of lens and grade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identifiers import tidy_upper
from tessella.functions.text import strict_grade, strict_lens
from tessella.llm.quotas import draw_quotas, quota_report
from tessella.plans.registry import Registry
from tessella.session import read

REGISTRY = Registry()
query = REGISTRY.query

#: Share of the usable images that is drawn.
FRACTION = (2, 5)


def usable_images(qc: DataFrame) -> DataFrame:
    """(image_id, objective_lens, isup_grade): each image by its newest row, if that can be used."""
    rows = qc.select(tidy_upper("image_id").alias("image_id"), F.struct("ingested_at", "row_no", strict_lens(F.col("objective_lens")).alias("lens"), strict_grade(F.col("isup_grade")).alias("grade")).alias("row")).filter("image_id IS NOT NULL")
    newest = rows.groupBy("image_id").agg(F.max("row").alias("row"))
    return newest.filter("row.lens IS NOT NULL AND row.grade IS NOT NULL").select("image_id", F.col("row.lens").alias("objective_lens"), F.col("row.grade").alias("isup_grade"))


def _report(spark: SparkSession, sf_dir: str, usable: DataFrame) -> DataFrame:
    return quota_report(usable, read(spark, sf_dir, "lens_targets"), "objective_lens", "isup_grade", "target_share", "min_rows", FRACTION)


_SQL = r"""
WITH newest AS (SELECT * FROM qc_objective_lens WHERE trim(image_id) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(image_id)) ORDER BY ingested_at DESC, row_no DESC) = 1),
u AS (SELECT try_cast(regexp_extract(trim(objective_lens), '^(4|10|20|40)(\.0)?\s*[xX×]?$', 1) AS INT) AS l, try_cast(regexp_extract(trim(isup_grade), '^((ISUP|Grade|Glade)\s*[:=]?\s*)?([0-5])(\.0)?$', 3, 'i') AS INT) AS g FROM newest),
k AS (SELECT l, g, count(*) AS n FROM u WHERE l IS NOT NULL AND g IS NOT NULL GROUP BY l, g),
s AS (SELECT sum(n) * 2 // 5 AS n FROM k)
SELECT t.objective_lens, t.isup_grade FROM lens_targets t CROSS JOIN s LEFT JOIN k ON k.l = t.objective_lens AND k.g = t.isup_grade
WHERE coalesce(k.n, 0) < t.min_rows OR coalesce(k.n, 0) < CAST(t.target_share AS DECIMAL(18,9)) * s.n"""


@query("p3_found", sql=_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of lens and grade whose target or minimum can't be met."""
    report = _report(spark, sf_dir, usable_images(read(spark, sf_dir, "qc_objective_lens")))
    return report.filter("NOT met").select("objective_lens", "isup_grade")


@query("p3_report")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, quotas and what was drawn of each pair."""
    return _report(spark, sf_dir, usable_images(read(spark, sf_dir, "qc_objective_lens")))


@query("p3_sample")
def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself."""
    usable = usable_images(read(spark, sf_dir, "qc_objective_lens"))
    return draw_quotas(usable, "image_id", "objective_lens", "isup_grade", _report(spark, sf_dir, usable))
