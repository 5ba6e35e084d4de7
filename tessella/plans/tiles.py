"""Queries of tile grids, eligibility, caps and review reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.identifiers import tidy_upper
from tessella.operators.imaging import review_reasons
from tessella.plans.registry import Registry
from tessella.session import read

REGISTRY = Registry()
query = REGISTRY.query

_IMAGES = "(SELECT row_no, width, height FROM processing WHERE width > 0 AND height > 0)"


@query("join15_tile_grid", f"""SELECT row_no, x.x AS x, y.y AS y, least(256, width - x.x) AS valid_w, least(256, height - y.y) AS valid_h FROM {_IMAGES} i, LATERAL (SELECT unnest(range(0, width, 256)) AS x) x, LATERAL (SELECT unnest(range(0, height, 256)) AS y) y""")
def join15(spark, sf_dir):
    """The grid of each image, by two generators instead of a join."""
    rows = read(spark, sf_dir, "processing").filter("width > 0 AND height > 0").select("row_no", "width", "height")
    grid = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(256)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(256))))
    return grid.select("row_no", "x", "y", F.least(F.lit(256), F.col("width") - F.col("x")).alias("valid_w"), F.least(F.lit(256), F.col("height") - F.col("y")).alias("valid_h"))


@query("img07_grid_count", f"SELECT p.row_no, CAST(ceil(p.width / 256) * ceil(p.height / 256) AS BIGINT) AS grid_tiles, CAST(greatest(0, ceil(p.width / 256) * ceil(p.height / 256) - coalesce(p.tiles_eligible, 0)) AS BIGINT) AS rejected FROM processing p WHERE width > 0 AND height > 0")
def img07(spark, sf_dir):
    grid = F.ceil(F.col("width") / 256) * F.ceil(F.col("height") / 256)
    return read(spark, sf_dir, "processing").filter("width > 0 AND height > 0").select("row_no", grid.alias("grid_tiles"), F.greatest(F.lit(0), grid - F.coalesce("tiles_eligible", F.lit(0))).alias("rejected"))


_LEAST = "CASE WHEN objective_lens <= 10 THEN 0.03e0 WHEN objective_lens <= 20 THEN 0.02e0 ELSE 0.04e0 END"
_ELIGIBLE = f"(SELECT tile_no, upper(trim(slide_id)) AS slide_id, x, y FROM tissue_detection WHERE tissue_ratio > 0 AND tissue_ratio >= {_LEAST} AND trim(slide_id) <> '')"


def eligible(spark, sf_dir) -> DataFrame:
    """Tiles with tissue, and enough of it for their lens; a tile without any never passes."""
    least = F.when(F.col("objective_lens") <= 10, 0.03).when(F.col("objective_lens") <= 20, 0.02).otherwise(0.04)
    rows = read(spark, sf_dir, "tissue_detection").filter((F.col("tissue_ratio") > 0) & (F.col("tissue_ratio") >= least))
    return rows.select("tile_no", tidy_upper("slide_id").alias("slide_id"), "x", "y").filter("slide_id IS NOT NULL")


@query("flt07_eligible_tiles", f"SELECT tile_no FROM {_ELIGIBLE}")
def flt07(spark, sf_dir):
    return eligible(spark, sf_dir).select("tile_no")


@query("flt08_white_tiles", "SELECT count(*) FILTER (tissue_ratio <= 0.005e0) AS n_white, count(*) FILTER (tissue_ratio > 0.005e0) AS n_kept FROM tissue_detection")
def flt08(spark, sf_dir):
    return read(spark, sf_dir, "tissue_detection").agg(F.count_if(F.col("tissue_ratio") <= 0.005).alias("n_white"), F.count_if(F.col("tissue_ratio") > 0.005).alias("n_kept"))


@query("win08_tile_cap", f"SELECT slide_id, tile_no, place, n_eligible FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY y, x, tile_no) AS place, count(*) OVER (PARTITION BY slide_id) AS n_eligible FROM {_ELIGIBLE}) WHERE place <= 4")
def win08(spark, sf_dir):
    """The first four eligible tiles of each slide in raster order, and how many there are.

    The limit is pushed below the shuffle (per task at most four rows a slide); the
    totals come from an aggregate, not from the same window.
    """
    rows = eligible(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("slide_id").orderBy("y", "x", "tile_no"))
    first = rows.withColumn("place", place).filter("place <= 4")
    return first.join(rows.groupBy("slide_id").agg(F.count("*").alias("n_eligible")), "slide_id").select("slide_id", "tile_no", "place", "n_eligible")


@query("win09_shuffled_cap", f"SELECT slide_id, tile_no FROM {_ELIGIBLE} QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY md5('42|' || x || '|' || y), tile_no) <= 4")
def win09(spark, sf_dir):
    key = F.md5(F.concat_ws("|", F.lit("42"), F.col("x").cast("string"), F.col("y").cast("string")))
    place = F.row_number().over(W.partitionBy("slide_id").orderBy(key, "tile_no"))
    return eligible(spark, sf_dir).filter("x IS NOT NULL AND y IS NOT NULL").withColumn("place", place).filter("place <= 4").select("slide_id", "tile_no")


_REASONS = """list_filter([CASE WHEN tissue_fraction <= 0 THEN 'no_tissue' END, CASE WHEN duplicate_source_content THEN 'duplicate_source_content' END, CASE WHEN focus_score < 40 THEN 'focus_below_review_threshold' END, CASE WHEN tiles_eligible = 0 THEN 'no_tiles_met_tissue_threshold' END], lambda r: r IS NOT NULL)"""


@query("qc01_review_reasons", f"SELECT row_no, {_REASONS} AS review_reasons FROM processing")
def qc01(spark, sf_dir):
    reasons = review_reasons(F.col("tissue_fraction"), F.col("duplicate_source_content"), F.col("focus_score"), F.col("tiles_eligible"), 40.0)
    return read(spark, sf_dir, "processing").select("row_no", reasons.alias("review_reasons"))


@query("agg32_shard_stats", f"""SELECT objective_lens, count(*) AS images_seen, CAST(sum(tiles_written) AS BIGINT) AS tiles_written, count(*) FILTER (len({_REASONS}) > 0) AS images_review, count(*) FILTER (duplicate_source_content) AS images_duplicate_source, count(*) FILTER (tissue_fraction <= 0) AS images_no_tissue FROM processing GROUP BY 1""")
def agg32(spark, sf_dir):
    reasons = review_reasons(F.col("tissue_fraction"), F.col("duplicate_source_content"), F.col("focus_score"), F.col("tiles_eligible"), 40.0)
    return read(spark, sf_dir, "processing").groupBy("objective_lens").agg(F.count("*").alias("images_seen"), F.sum("tiles_written").alias("tiles_written"), F.count_if(F.size(reasons) > 0).alias("images_review"), F.count_if("duplicate_source_content").alias("images_duplicate_source"), F.count_if(F.col("tissue_fraction") <= 0).alias("images_no_tissue"))


@query("flt19_output_checks", """SELECT count(*) FILTER (tiles_written > tiles_eligible) AS more_written, count(*) FILTER (decode_ok AND (width <= 0 OR height <= 0)) AS bad_geometry, count(*) FILTER (NOT regexp_full_match(lower(source_sha256), '[0-9a-f]{64}')) AS bad_digest, count(*) FILTER (status = 'pass' AND len(reasons) > 0) AS pass_with_reasons FROM processing""")
def flt19(spark, sf_dir):
    return read(spark, sf_dir, "processing").agg(F.count_if(F.col("tiles_written") > F.col("tiles_eligible")).alias("more_written"), F.count_if(F.col("decode_ok") & ((F.col("width") <= 0) | (F.col("height") <= 0))).alias("bad_geometry"), F.count_if(~F.lower("source_sha256").rlike(r"\A[0-9a-f]{64}\z")).alias("bad_digest"), F.count_if((F.col("status") == "pass") & (F.size("reasons") > 0)).alias("pass_with_reasons"))
