"""Queries on the text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.identifiers import tidy_path
from tessella.plans.registry import Registry
from tessella.session import read

REGISTRY = Registry()
query = REGISTRY.query

_CLEAN = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"


@query("scl02_clean_text", r"SELECT row_no, regexp_replace(trim(regexp_replace(coalesce(isup_grade, ''), '\s+', ' ', 'g')), '\.0$', '') AS grade_text FROM qc_objective_lens")
def scl02(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.clean_text(F.col("isup_grade")).alias("grade_text"))


@query("scl03_clean", f"SELECT row_no, {_CLEAN.format('image_id')} AS image_id FROM qc_objective_lens")
def scl03(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.clean(F.col("image_id")).alias("image_id"))


@query("scl04_loose_grade", r"SELECT row_no, try_cast(nullif(regexp_extract(isup_grade, '(\d+)', 1), '') AS INT) AS grade FROM qc_objective_lens")
def scl04(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.loose_grade(F.col("isup_grade")).alias("grade"))


@query("scl05_strict_grade", r"SELECT row_no, try_cast(regexp_extract(trim(isup_grade), '^((ISUP|Grade|Glade)\s*[:=]?\s*)?([0-5])(\.0)?$', 3, 'i') AS INT) AS grade FROM qc_objective_lens")
def scl05(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.strict_grade(F.col("isup_grade")).alias("grade"))


@query("scl06_loose_lens", r"SELECT row_no, CASE WHEN regexp_matches(coalesce(objective_lens, ''), '\d') THEN regexp_extract(objective_lens, '(\d+)', 1) || 'X' ELSE '' END AS lens FROM qc_objective_lens")
def scl06(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.loose_lens(F.col("objective_lens")).alias("lens"))


_LENS_TEXT = rf"regexp_replace(replace(upper({_CLEAN.format('objective_lens')}), ' ', ''), '\.0$', '')"


@query("scl07_lens_text", rf"SELECT row_no, CASE WHEN regexp_full_match({_LENS_TEXT}, '\d+') THEN {_LENS_TEXT} || 'X' ELSE {_LENS_TEXT} END AS lens FROM qc_objective_lens")
def scl07(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.lens_text(F.col("objective_lens")).alias("lens"))


@query("scl08_strict_lens", r"SELECT row_no, try_cast(regexp_extract(trim(objective_lens), '^(4|10|20|40)(\.0)?\s*[xX×]?$', 1) AS INT) AS lens FROM qc_objective_lens")
def scl08(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.strict_lens(F.col("objective_lens")).alias("lens"))


@query("scl09_catalog_lens", r"SELECT row_no, try_cast(regexp_extract(trim(objective_lens), '^(4|10|40)[xX×]?$', 1) AS INT) AS lens FROM qc_objective_lens")
def scl09(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.catalog_lens(F.col("objective_lens")).alias("lens"))


@query("scl10_lens_number", rf"SELECT row_no, coalesce(try_cast(nullif(regexp_extract({_LENS_TEXT}, '^(\d+)X?$', 1), '') AS INT), 10) AS lens FROM qc_objective_lens")
def scl10(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.lens_number(F.col("objective_lens")).alias("lens"))


@query("scl11_year_code", r"SELECT row_no, upper(regexp_replace(split_part(case_id, '_', 1), '[\s-]+', '', 'g')) AS year_code FROM catalog_images")
def scl11(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").select("row_no", X.year_code(F.split_part("case_id", F.lit("_"), F.lit(1))).alias("year_code"))


@query("scl12_case_id", r"SELECT row_no, nullif(upper(regexp_replace(split_part(case_id, '_', 1), '[\s-]+', '', 'g')), '') || '_' || nullif(trim(split_part(case_id, '_', 2)), '') AS case_key FROM catalog_images")
def scl12(spark, sf_dir):
    parts = [F.split_part("case_id", F.lit("_"), F.lit(i)) for i in (1, 2)]
    return read(spark, sf_dir, "catalog_images").select("row_no", X.case_id(*parts).alias("case_key"))


@query("scl13_patient_key", """SELECT row_no, '["' || source_id || '", "' || slide_group_id || '"]' AS patient_key FROM catalog_images""")
def scl13(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").select("row_no", X.patient_key(F.col("source_id"), F.col("slide_group_id")).alias("patient_key"))


@query("scl14_report_label", "SELECT row_no, CASE WHEN contains(upper(ket_luan), 'CARCIN') THEN 1 WHEN contains(upper(ket_luan), 'TĂNG SẢN') OR contains(upper(ket_luan), 'HYPERPLASIA') THEN 0 END AS label FROM catalog_images")
def scl14(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").select("row_no", X.report_label(F.col("ket_luan")).alias("label"))


@query("scl15_binary_label", "SELECT tile_no, CAST(isup > 0 AS INT) AS label FROM tissue_detection")
def scl15(spark, sf_dir):
    return read(spark, sf_dir, "tissue_detection").select("tile_no", (F.col("isup") > 0).cast("int").alias("label"))


@query("scl16_file_stem", r"SELECT row_no, regexp_extract(source_member, '([^/\\]+?)(\.[^./\\]*)?$', 1) AS stem FROM catalog_images")
def scl16(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").select("row_no", X.file_stem(F.col("source_member")).alias("stem"))


@query("scl17_safe_member", r"""SELECT tile_no, tile_path <> '' AND NOT regexp_matches(tile_path, '[\\:]') AND NOT regexp_matches(tile_path, '^/|/$|//') AND NOT regexp_matches(tile_path, '(^|/)\.{1,2}(/|$)') AS safe FROM tissue_detection""")
def scl17(spark, sf_dir):
    return read(spark, sf_dir, "tissue_detection").select("tile_no", X.safe_member(F.col("tile_path")).alias("safe"))


@query("scl18_safe_id", "SELECT row_no, regexp_full_match(image_id, '[A-Za-z0-9_.-]+') AS safe FROM catalog_images")
def scl18(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").select("row_no", X.safe_id(F.col("image_id")).alias("safe"))


@query("scl19_output_member", r"SELECT row_no, 'images/' || image_id || lower(regexp_extract(file_name, '[^/.](\.[^./]*)$', 1)) AS member FROM catalog_images")
def scl19(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").select("row_no", X.output_member(F.col("image_id"), F.col("file_name")).alias("member"))


@query("scl20_slug", "SELECT row_no, regexp_replace(ket_luan, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM catalog_images")
def scl20(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").select("row_no", X.slug(F.col("ket_luan")).alias("slug"))


@query("scl21_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def scl21(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("scl22_fingerprint", """SELECT row_no, sha256('{"image_id":"' || image_id || '","objective_lens":' || objective_lens || ',"source_id":"' || source_id || '"}') AS fingerprint FROM catalog_images""")
def scl22(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").select("row_no", X.fingerprint(image_id=F.col("image_id"), objective_lens=F.col("objective_lens"), source_id=F.col("source_id")).alias("fingerprint"))


@query("scl23_spaced_fingerprint", """SELECT row_no, sha256('{"image_id": "' || image_id || '", "objective_lens": ' || objective_lens || '}') AS fingerprint FROM catalog_images""")
def scl23(spark, sf_dir):
    """The dialect with ', ' and ': ', whose digests differ from those of scl22."""
    text = F.concat(F.lit('{"image_id": "'), "image_id", F.lit('", "objective_lens": '), F.col("objective_lens").cast("string"), F.lit("}"))
    return read(spark, sf_dir, "catalog_images").select("row_no", F.sha2(text, 256).alias("fingerprint"))


_TILE = """sha256('{{"config_id":"c1","h":256,{}"image_sha256":"' || i.sha || '","w":256,"x":' || t.x || ',"y":' || t.y || '}}')"""
_DIGESTS = "(SELECT upper(trim(image_id)) AS image_id, min(lower(source_sha256)) AS sha FROM processing WHERE source_sha256 IS NOT NULL AND trim(image_id) <> '' GROUP BY 1)"


def _tile_digests(spark, sf_dir):
    from tessella.functions.identifiers import tidy_upper

    images = read(spark, sf_dir, "processing").filter("source_sha256 IS NOT NULL").select(tidy_upper("image_id").alias("image_id"), F.lower("source_sha256").alias("sha")).groupBy("image_id").agg(F.min("sha").alias("sha"))
    tiles = read(spark, sf_dir, "tissue_detection").select("tile_no", tidy_upper("slide_id").alias("image_id"), "x", "y")
    fixed = {"image_sha256": F.col("sha"), "x": F.col("x"), "y": F.col("y"), "w": F.lit(256), "h": F.lit(256), "config_id": F.lit("c1")}
    return tiles.join(images, "image_id"), fixed


@query("scl24_tile_id", f"""SELECT t.tile_no, {_TILE.format('"image_id":"' + "' || i.image_id || '" + '",')} AS tile_id FROM tissue_detection t JOIN {_DIGESTS} i ON i.image_id = upper(trim(t.slide_id)) WHERE t.x IS NOT NULL AND t.y IS NOT NULL""")
def scl24(spark, sf_dir):
    tiles, fixed = _tile_digests(spark, sf_dir)
    return tiles.filter("x IS NOT NULL AND y IS NOT NULL").select("tile_no", X.fingerprint(image_id=F.col("image_id"), **fixed).alias("tile_id"))


@query("scl25_content_tile_id", f"""SELECT t.tile_no, {_TILE.format('')} AS content_tile_id FROM tissue_detection t JOIN {_DIGESTS} i ON i.image_id = upper(trim(t.slide_id)) WHERE t.x IS NOT NULL AND t.y IS NOT NULL""")
def scl25(spark, sf_dir):
    tiles, fixed = _tile_digests(spark, sf_dir)
    return tiles.filter("x IS NOT NULL AND y IS NOT NULL").select("tile_no", X.fingerprint(**fixed).alias("content_tile_id"))


@query("scl28_min_tissue", "SELECT tile_no, CASE WHEN objective_lens <= 10 THEN 0.03e0 WHEN objective_lens <= 20 THEN 0.02e0 ELSE 0.04e0 END AS min_tissue FROM tissue_detection")
def scl28(spark, sf_dir):
    least = F.when(F.col("objective_lens") <= 10, 0.03).when(F.col("objective_lens") <= 20, 0.02).otherwise(0.04)
    return read(spark, sf_dir, "tissue_detection").select("tile_no", least.alias("min_tissue"))


@query("scl31_unknown_fill", "SELECT row_no, coalesce(nullif(trim(data_provider), ''), 'Unknown') AS provider FROM qc_objective_lens")
def scl31(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", F.coalesce(F.nullif(F.trim("data_provider"), F.lit("")), F.lit("Unknown")).alias("provider"))


@query("scl32_method_flags", "SELECT * FROM (VALUES ('E0_none', false, false), ('E1_percentile', true, false), ('E2_clahe', false, true), ('E3_percentile_clahe', true, true)) t(method, percentile, clahe)")
def scl32(spark, sf_dir):
    return spark.createDataFrame([("E0_none", False, False), ("E1_percentile", True, False), ("E2_clahe", False, True), ("E3_percentile_clahe", True, True)], "method string, percentile boolean, clahe boolean")


@query("scl33_plain_number", r"SELECT row_no, CASE WHEN try_cast(isup_grade AS DOUBLE) = round(try_cast(isup_grade AS DOUBLE)) THEN CAST(CAST(try_cast(isup_grade AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE isup_grade END AS grade_text FROM qc_objective_lens")
def scl33(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", X.plain_number(F.col("isup_grade")).alias("grade_text"))


@query("scl34_tar_record", "SELECT row_no, CAST(512 + ceil(byte_size / 512) * 512 AS BIGINT) AS record_bytes FROM shards WHERE byte_size IS NOT NULL")
def scl34(spark, sf_dir):
    return read(spark, sf_dir, "shards").filter("byte_size IS NOT NULL").select("row_no", X.tar_record_bytes(F.col("member"), F.col("byte_size")).cast("long").alias("record_bytes"))


@query("scl35_tidy_path", r"SELECT tile_no, nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(tile_path)), '[/\\]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '/\.$', ''), '/'), '') AS path FROM tissue_detection")
def scl35(spark, sf_dir):
    return read(spark, sf_dir, "tissue_detection").select("tile_no", tidy_path("tile_path").alias("path"))
