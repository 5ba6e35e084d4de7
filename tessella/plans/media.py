"""Queries of inventories, JSON, listings, pixel kernels and batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import pixels as P
from tessella.functions import text as X
from tessella.functions.identifiers import tidy_lower
from tessella.operators import imaging
from tessella.operators.scoring import score
from tessella.plans.registry import Registry
from tessella.session import read
from tessella.sources.files import to_download
from tessella.streaming.commits import settings_id

REGISTRY = Registry()
query = REGISTRY.query


@query("src05_file_inventory")
def src05(spark, sf_dir):
    """Files below the data folder with their sizes; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(sf_dir)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("byte_size"))


_STEM = r"regexp_extract(file_name, '([^/\\]+?)(\.[^./\\]*)?$', 1)"


@query("src06_last_by_stem", f"SELECT {_STEM} AS stem, max(source_member) AS source_member FROM catalog_images GROUP BY 1")
def src06(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").groupBy(X.file_stem(F.col("file_name")).alias("stem")).agg(F.max("source_member").alias("source_member"))


@query("src11_source_selection", "SELECT printf('source-%03d', row_number() OVER (ORDER BY kind, lower(trim(source_id))) - 1) AS chosen_id, lower(trim(source_id)) AS source_id, kind FROM image_sources WHERE closed_at IS NULL")
def src11(spark, sf_dir):
    """Open sources, directories first, numbered anew; a fixed table of some dozens of rows."""
    from pyspark.sql import Window as W

    rows = read(spark, sf_dir, "image_sources").filter("closed_at IS NULL").select(tidy_lower("source_id").alias("source_id"), "kind")
    return rows.withColumn("chosen_id", F.format_string("source-%03d", F.row_number().over(W.orderBy("kind", "source_id")) - 1))


@query("src16_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def src16(spark, sf_dir):
    """A strict read of JSON with a declared schema."""
    parsed = F.from_json("props", "k int", {"mode": "FAILFAST"})
    return read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query("src19_mask_stems", rf"SELECT DISTINCT {_STEM} AS stem FROM qc_objective_lens WHERE regexp_matches(lower(file_name), '\.tiff?$')")
def src19(spark, sf_dir):
    rows = read(spark, sf_dir, "qc_objective_lens").filter(F.lower("file_name").rlike(r"\.tiff?\z"))
    return rows.select(X.file_stem(F.col("file_name")).alias("stem")).distinct()


@query("src21_to_download", """SELECT s.row_no FROM shards s WHERE NOT EXISTS (SELECT 1 FROM catalog_images c WHERE 'images/' || c.file_name = s.member AND c.byte_size = s.byte_size AND lower(trim(c.source_signature)) = lower(trim(s.sha256)))""")
def src21(spark, sf_dir):
    """Listed files that are absent or differ in size or digest."""
    listing = read(spark, sf_dir, "shards").select("row_no", F.col("member").alias("path"), F.col("byte_size").alias("size"), tidy_lower("sha256").alias("md5"))
    local = read(spark, sf_dir, "catalog_images").select(F.concat(F.lit("images/"), "file_name").alias("path"), F.col("byte_size").alias("size"), tidy_lower("source_signature").alias("md5"))
    return to_download(listing, local).select("row_no")


@query("snk04_json_lines", """SELECT row_no, '{"image_id":"' || image_id || '","objective_lens":' || objective_lens || ',"row_no":' || row_no || '}' AS line FROM catalog_images""")
def snk04(spark, sf_dir):
    """Rows as JSON text with sorted keys."""
    return read(spark, sf_dir, "catalog_images").select("row_no", F.to_json(F.struct("image_id", "objective_lens", "row_no"), {"ignoreNullFields": "false"}).alias("line"))


@query("scl26_config_id", """SELECT sha256('{"min_tiles":1,"stride":256,"tile_size":256}') AS config_id""")
def scl26(spark, sf_dir):
    return spark.createDataFrame([(settings_id({"tile_size": 256, "stride": 256, "min_tiles": 1}),)], "config_id string")


def _small_images(spark, sf_dir):
    """Each embedding as a grey 8 x 8 image, its bytes made on the JVM."""
    value = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 400 + 200))).cast("long")), 2, "0"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("n_channels"), F.unhex(F.array_join(value, "")).alias("data"))


#: Grey pixels as SQL: of equal channels, so only their density tells stain, and the ground is made of bright ones.
_GREY = """px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, b[i + 1] AS v FROM (SELECT vec_id, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(e::DOUBLE * 400 + 200))) AS INT)) AS b, unnest(range(64)) AS i FROM embeddings))"""
_LAP = """(SELECT c.vec_id, n.v + s.v + w.v + e.v - 4 * c.v AS lap FROM px c JOIN px n ON n.vec_id = c.vec_id AND n.x = c.x AND n.y = greatest(0, c.y - 1) JOIN px s ON s.vec_id = c.vec_id AND s.x = c.x AND s.y = least(7, c.y + 1)
JOIN px w ON w.vec_id = c.vec_id AND w.y = c.y AND w.x = greatest(0, c.x - 1) JOIN px e ON e.vec_id = c.vec_id AND e.y = c.y AND e.x = least(7, c.x + 1))"""


@query("img03_image_quality", f"""WITH {_GREY}, f AS (SELECT vec_id, round(var_pop(lap) + 1e-7, 4) AS focus_score FROM {_LAP} GROUP BY 1), g AS (SELECT vec_id, round(greatest(1, least(255, quantile_cont(v::DOUBLE, 0.99))), 3) AS q FROM px GROUP BY 1)
SELECT CAST(vec_id AS VARCHAR) AS image_id, true AS decode_ok, 8 AS width, 8 AS height, [q, q, q] AS background_reference_rgb, 0.0e0 AS tissue_fraction, focus_score, 0 AS tiles_eligible, 'ok' AS status FROM f JOIN g USING (vec_id)""")
def img03(spark, sf_dir):
    """Background, tissue, focus and eligible tiles of small images, by the Arrow kernels; grey ones have no tissue."""
    rows = imaging.quality(_small_images(spark, sf_dir), P.Settings(tile_size=4, stride=4))
    return rows.withColumn("background_reference_rgb", F.transform("background_reference_rgb", lambda v: F.round(v, 3))).withColumn("focus_score", F.round(F.col("focus_score") + 1e-7, 4))


@query("img06_image_tiles", f"""WITH {_GREY}, g AS (SELECT vec_id, coalesce(greatest(1, least(255, quantile_cont(v::DOUBLE, 0.99) FILTER (ln(256) - ln(1 + v) < 0.05e0))), 255) AS q FROM px GROUP BY 1),
t AS (SELECT vec_id, x // 4 * 4 AS x, y // 4 * 4 AS y, avg(CAST(ln(1 + q) - ln(1 + v) >= 0.05e0 AS INT)) AS f FROM px JOIN g USING (vec_id) GROUP BY vec_id, x // 4, y // 4)
SELECT CAST(vec_id AS VARCHAR) AS image_id, x, y, 4 AS w, 4 AS h, 4 AS valid_w, 4 AS valid_h, round(f, 6) AS tissue_fraction, row_number() OVER (PARTITION BY vec_id ORDER BY y, x) AS place FROM t WHERE f > 0""")
def img06(spark, sf_dir):
    """The grid tiles of small images that hold dense pixels, in raster order."""
    found = imaging.tiles(_small_images(spark, sf_dir), P.Settings(tile_size=4, stride=4, min_tissue=0.0, green_contrast=0.0))
    return found.drop("png").withColumn("tissue_fraction", F.round("tissue_fraction", 6))


@query("udf05_batch_scores", "SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS y_prob FROM embeddings")
def udf05(spark, sf_dir):
    """Scores by a pluggable model, here the mean of the vector."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return score(rows, lambda: lambda m: m.mean(axis=1), "v").select("vec_id", F.round("y_prob", 6).alias("y_prob"))
