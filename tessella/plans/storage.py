"""Queries on files and references (problems 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identifiers import file_of, tidy_lower, tidy_path, tidy_upper
from tessella.operators.compaction import checksum, freeze_manifest, pack_bins, tar_members
from tessella.operators.references import Reference, orphan_report, orphans
from tessella.plans.registry import Registry
from tessella.session import cut_lineage, read, scratch_folder

REGISTRY = Registry()
query = REGISTRY.query

_TILE_FILE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(tile_path)), '[/\\]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '/\.$', ''), '/')"
_TAR_KEY = r"regexp_extract(lower(trim(tar_name)), '([^/\\]+)$', 1)"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles, shards = read(spark, sf_dir, "tissue_detection"), read(spark, sf_dir, "shards")
    return freeze_manifest(
        tiles, F.col("tile_no"), tidy_path("tile_path"), F.col("png_bytes"),
        shards, file_of(tidy_path("tar_name")), F.col("member"), F.col("byte_size"),
    )


@query("p4_found", sql=rf"""
WITH m AS (SELECT {_TAR_KEY} AS k, member, max(byte_size) AS b FROM shards WHERE trim(tar_name) <> '' GROUP BY 1, 2),
t AS (SELECT tile_no, min(tile_no) OVER (PARTITION BY {_TILE_FILE}) AS f FROM tissue_detection WHERE trim(tile_path) <> '')
SELECT 'tar' AS file_kind, k AS file_key FROM m GROUP BY k HAVING coalesce(sum(b), 0) < 4194304
UNION ALL SELECT 'tile', CAST(tile_no AS VARCHAR) FROM t WHERE tile_no > f""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tars too small to stand alone, as they are packed, and tile rows naming a file that is listed already."""
    manifest = _manifest(spark, sf_dir)
    tars = _bins(cut_lineage(manifest.filter("file_kind = 'tar' AND action = 'pack'")))
    again = manifest.filter("file_kind = 'tile' AND action = 'drop'")
    return tars.select("file_kind", "file_key").unionByName(again.select("file_kind", "file_key"))


@query("p4_bins")
def p4_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new file of every small file: first-fit decreasing into files of 128 MiB."""
    return _bins(cut_lineage(_manifest(spark, sf_dir).filter("action = 'pack'")))


def _bins(manifest: DataFrame) -> DataFrame:
    packed = pack_bins(manifest, "file_kind", "file_key", "bytes")
    return packed.select(F.col("kind").alias("file_kind"), F.col("key").alias("file_key"), "bytes", F.col("bin").alias("new_file"))


@query("p4_report", sql=rf"""
WITH m AS (SELECT {_TAR_KEY} AS k, member, max(byte_size) AS b FROM shards WHERE trim(tar_name) <> '' GROUP BY 1, 2),
small AS (SELECT k, coalesce(sum(b), 0) AS b FROM m GROUP BY k HAVING coalesce(sum(b), 0) < 4194304),
t AS (SELECT tile_no, png_bytes, min(tile_no) OVER (PARTITION BY {_TILE_FILE}) AS f FROM tissue_detection WHERE trim(tile_path) <> ''),
r AS (SELECT 'tar' AS file_kind, k AS file, coalesce(m.b, 0) AS b FROM m JOIN small USING (k)
  UNION ALL SELECT 'tile', CAST(tile_no AS VARCHAR), coalesce(png_bytes, 0) FROM t WHERE tile_no = f AND coalesce(png_bytes, 0) < 4194304)
SELECT file_kind, count(DISTINCT file) AS n_files, count(*) AS records_in, count(*) AS records_out, CAST(sum(b) AS BIGINT) AS bytes_in, CAST(sum(b) AS BIGINT) AS bytes_out, true AS agree FROM r GROUP BY file_kind""")
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: records (tiles, images of tars) and bytes in the manifest, and in the regrouped files that were written.

    The manifest is written once, its files are packed, and the records are rewritten as
    one file a bin in the shared folder. `agree` compares checksums over all records.
    """
    tiles = _manifest(spark, sf_dir).filter("file_kind = 'tile' AND action = 'pack'").select("file_kind", "file_key", F.col("file_key").alias("record"), F.coalesce("bytes", F.lit(0)).cast("long").alias("record_bytes"))
    small = _manifest(spark, sf_dir).filter("file_kind = 'tar' AND action = 'pack'").select("file_kind", "file_key")
    members = tar_members(read(spark, sf_dir, "shards"), file_of(tidy_path("tar_name")), F.col("member"), F.col("byte_size"))
    held = small.join(members.select(F.col("tar").alias("file_key"), F.col("member").alias("record"), F.coalesce("size", F.lit(0)).alias("record_bytes")), "file_key").select(*tiles.columns)
    frozen = cut_lineage(tiles.unionByName(held))
    files = frozen.groupBy("file_kind", "file_key").agg(F.sum("record_bytes").alias("bytes"))
    bins = cut_lineage(_bins(files))
    folder = scratch_folder(spark, "regrouped")
    placed = frozen.join(bins.select("file_kind", "file_key", "new_file"), ["file_kind", "file_key"])
    placed.repartition("new_file").sortWithinPartitions("new_file", "file_key", "record").write.partitionBy("new_file").parquet(folder)
    written = spark.read.schema(frozen.schema).parquet(folder).select(*frozen.columns)

    def sums(rows: DataFrame, side: str) -> DataFrame:
        totals = rows.groupBy("file_kind").agg(F.sum("record_bytes").alias(f"bytes_{side}"), F.countDistinct("file_key").alias(f"n_{side}"))
        return checksum(rows, ["file_kind"]).join(totals, "file_kind").select("file_kind", F.col("rows").alias(f"records_{side}"), f"bytes_{side}", f"n_{side}", F.col("digest").alias(f"digest_{side}"))

    both = sums(frozen, "in").join(sums(written, "out"), "file_kind", "left")
    agree = F.coalesce((F.col("digest_in") == F.col("digest_out")) & (F.col("n_in") == F.col("n_out")), F.lit(False))
    return both.select("file_kind", F.col("n_in").alias("n_files"), "records_in", F.coalesce("records_out", F.lit(0)).alias("records_out"), "bytes_in", F.coalesce("bytes_out", F.lit(0)).alias("bytes_out"), agree.alias("agree"))


def _references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    shards, tiles = read(spark, sf_dir, "shards"), read(spark, sf_dir, "tissue_detection")
    catalog, sources, qc = read(spark, sf_dir, "catalog_images"), read(spark, sf_dir, "image_sources"), read(spark, sf_dir, "qc_objective_lens")
    return [
        Reference("shards", "image_id", shards, F.col("row_no"), tidy_upper("image_id"), F.col("committed_at"), catalog, tidy_upper("image_id"), F.col("added_at"), F.col("deleted_at")),
        Reference("shards", "source_id", shards, F.col("row_no"), tidy_lower("source_id"), F.col("committed_at"), sources, tidy_lower("source_id"), F.col("opened_at"), F.col("closed_at")),
        Reference("tissue_detection", "slide_id", tiles, F.col("tile_no"), tidy_upper("slide_id"), F.col("written_at"), qc, tidy_upper("image_id"), F.col("ingested_at")),
    ]


_LOST = """
SELECT 'shards' AS table_name, 'image_id' AS column_name, s.row_no AS record_no, s.committed_at AS ts FROM shards s
WHERE trim(s.image_id) <> '' AND NOT EXISTS (SELECT 1 FROM catalog_images c WHERE upper(trim(c.image_id)) = upper(trim(s.image_id))
  AND c.added_at <= s.committed_at AND (c.deleted_at IS NULL OR s.committed_at < c.deleted_at))
UNION ALL SELECT 'shards', 'source_id', s.row_no, s.committed_at FROM shards s
WHERE trim(s.source_id) <> '' AND NOT EXISTS (SELECT 1 FROM image_sources c WHERE lower(trim(c.source_id)) = lower(trim(s.source_id))
  AND c.opened_at <= s.committed_at AND (c.closed_at IS NULL OR s.committed_at < c.closed_at))
UNION ALL SELECT 'tissue_detection', 'slide_id', t.tile_no, t.written_at FROM tissue_detection t
WHERE trim(t.slide_id) <> '' AND NOT EXISTS (SELECT 1 FROM qc_objective_lens q WHERE upper(trim(q.image_id)) = upper(trim(t.slide_id)) AND q.ingested_at <= t.written_at)"""


@query("p5_found", sql=f"SELECT table_name, column_name, record_no FROM ({_LOST})")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that led nowhere when they were made."""
    return orphans(_references(spark, sf_dir)).select("table_name", "column_name", "record_no")


@query("p5_report", sql=f"""
WITH lost AS ({_LOST}), refs AS (
SELECT 'shards' AS table_name, 'image_id' AS column_name, committed_at AS ts FROM shards WHERE trim(image_id) <> ''
UNION ALL SELECT 'shards', 'source_id', committed_at FROM shards WHERE trim(source_id) <> ''
UNION ALL SELECT 'tissue_detection', 'slide_id', written_at FROM tissue_detection WHERE trim(slide_id) <> ''),
n AS (SELECT table_name, column_name, strftime(ts, '%Y-%m') AS month, count(*) AS n_references FROM refs GROUP BY ALL),
o AS (SELECT table_name, column_name, strftime(ts, '%Y-%m') AS month, count(*) AS n_orphans FROM lost GROUP BY ALL)
SELECT n.*, coalesce(o.n_orphans, 0) AS n_orphans FROM n LEFT JOIN o USING (table_name, column_name, month)""")
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table, column and month."""
    return orphan_report(_references(spark, sf_dir))
