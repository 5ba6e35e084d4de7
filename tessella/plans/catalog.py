"""Queries of the catalog: joins with the inventory, samples, duplicates, blockers, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.identifiers import tidy_lower, tidy_upper
from tessella.operators.splitting import balanced_sample
from tessella.plans.registry import Registry
from tessella.session import read

REGISTRY = Registry()
query = REGISTRY.query

#: Each image's newest entry, as SQL.
CURRENT = """(SELECT upper(trim(image_id)) AS image_id, objective_lens, upper(trim(case_id)) AS case_id, upper(nullif(trim(patient_id), '')) AS patient_id, case_label, source_signature, byte_size, ket_luan, lower(trim(source_id)) AS source_id, added_at, row_no
FROM catalog_images WHERE trim(image_id) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(image_id)) ORDER BY added_at DESC, row_no DESC) = 1)"""


def current(spark, sf_dir) -> DataFrame:
    """The newest entry of each image, by one aggregate."""
    kept = ["objective_lens", "case_label", "source_signature", "byte_size", "ket_luan"]
    rows = read(spark, sf_dir, "catalog_images").select(tidy_upper("image_id").alias("image_id"), F.struct("added_at", "row_no", *kept, tidy_upper("case_id").alias("case_id"), tidy_upper("patient_id").alias("patient_id"), tidy_lower("source_id").alias("source_id")).alias("r"))
    return rows.filter("image_id IS NOT NULL").groupBy("image_id").agg(F.max("r").alias("r")).select("image_id", "r.*")


@query("src10_names_in_several_sources", "SELECT file_name, count(DISTINCT lower(trim(source_id))) AS n_sources FROM catalog_images GROUP BY 1 HAVING count(DISTINCT lower(trim(source_id))) > 1")
def src10(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").groupBy("file_name").agg(F.countDistinct(tidy_lower("source_id")).alias("n_sources")).filter("n_sources > 1")


@query("join04_identity", f"""WITH o AS (SELECT upper(trim(slide_id)) AS s, min(upper(trim(patient_id))) AS p FROM slide_patient_map WHERE trim(slide_id) <> '' AND trim(patient_id) <> '' GROUP BY 1)
SELECT c.image_id, o.p AS verified_patient, CASE WHEN o.p IS NULL THEN 'candidate_case' ELSE 'verified_mapping' END AS identity_status FROM {CURRENT} c LEFT JOIN o ON o.s = c.image_id""")
def join04(spark, sf_dir):
    known = read(spark, sf_dir, "slide_patient_map").select(tidy_upper("slide_id").alias("image_id"), tidy_upper("patient_id").alias("p")).filter("image_id IS NOT NULL AND p IS NOT NULL").groupBy("image_id").agg(F.min("p").alias("verified_patient"))
    joined = current(spark, sf_dir).select("image_id").join(known, "image_id", "left")
    return joined.withColumn("identity_status", F.when(F.col("verified_patient").isNull(), "candidate_case").otherwise("verified_mapping"))


_PACKED = "(SELECT DISTINCT upper(trim(image_id)) AS image_id FROM shards WHERE trim(image_id) <> '')"


def packed(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "shards").select(tidy_upper("image_id").alias("image_id")).filter("image_id IS NOT NULL").distinct()


@query("join05_catalog_inventory", f"SELECT c.image_id, c.objective_lens FROM {CURRENT} c JOIN {_PACKED} p USING (image_id)")
def join05(spark, sf_dir):
    return current(spark, sf_dir).join(packed(spark, sf_dir), "image_id", "left_semi").select("image_id", "objective_lens")


@query("join05_missing_images", f"SELECT c.image_id FROM {CURRENT} c WHERE image_id NOT IN (SELECT image_id FROM {_PACKED})")
def join05_missing(spark, sf_dir):
    return current(spark, sf_dir).join(packed(spark, sf_dir), "image_id", "left_anti").select("image_id")


@query("join12_manifest_fields", f"""SELECT s.row_no, list_filter([CASE WHEN s.objective_lens IS DISTINCT FROM c.objective_lens THEN 'objective_lens' END, CASE WHEN upper(nullif(trim(s.case_id), '')) IS DISTINCT FROM c.case_id THEN 'case_id' END,
CASE WHEN s.case_label IS DISTINCT FROM c.case_label THEN 'case_label' END, CASE WHEN s.byte_size IS DISTINCT FROM c.byte_size THEN 'byte_size' END], lambda x: x IS NOT NULL) AS differing
FROM shards s JOIN {CURRENT} c ON c.image_id = upper(trim(s.image_id))
WHERE s.objective_lens IS DISTINCT FROM c.objective_lens OR upper(nullif(trim(s.case_id), '')) IS DISTINCT FROM c.case_id OR s.case_label IS DISTINCT FROM c.case_label OR s.byte_size IS DISTINCT FROM c.byte_size""")
def join12(spark, sf_dir):
    """Packed records whose fields differ from the catalog's, null being a value."""
    names = ["objective_lens", "case_id", "case_label", "byte_size"]
    s = read(spark, sf_dir, "shards").select("row_no", tidy_upper("image_id").alias("image_id"), "objective_lens", tidy_upper("case_id").alias("case_id"), "case_label", "byte_size").alias("s")
    joined = s.join(current(spark, sf_dir).alias("c"), "image_id")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"s.{n}").eqNullSafe(F.col(f"c.{n}")), n) for n in names]))
    return joined.select("s.row_no", differing.alias("differing")).filter(F.size("differing") > 0)


@query("win03_balanced_sample", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY objective_lens, case_label, case_id ORDER BY image_id) AS o FROM {CURRENT}),
b AS (SELECT *, row_number() OVER (PARTITION BY objective_lens, case_label ORDER BY o, case_id) AS r FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY objective_lens ORDER BY r, case_label NULLS LAST) AS place FROM b) SELECT objective_lens, place, image_id FROM c WHERE place <= 50""")
def win03(spark, sf_dir):
    return balanced_sample(current(spark, sf_dir), "objective_lens", "case_label", "case_id", "image_id", 50).select("objective_lens", "place", "image_id")


_RAW = f"(SELECT * FROM {CURRENT} WHERE regexp_full_match(source_signature, '[0-9a-f]{{64}}'))"


def raw_hashed(spark, sf_dir) -> DataFrame:
    return current(spark, sf_dir).filter(F.col("source_signature").rlike(r"\A[0-9a-f]{64}\z"))


@query("agg25_duplicate_groups", f"""SELECT source_signature AS sha256, list_sort(list(image_id)) AS image_ids, list_sort(list(DISTINCT patient_id) FILTER (patient_id IS NOT NULL)) AS patient_ids, list_sort(list(DISTINCT case_id)) AS case_ids FROM {_RAW} GROUP BY 1 HAVING count(*) > 1""")
def agg25(spark, sf_dir):
    """Images with equal bytes; only digests that occur twice are gathered into lists."""
    rows = raw_hashed(spark, sf_dir)
    twice = rows.groupBy("source_signature").agg(F.count("*").alias("n")).filter("n > 1").select("source_signature")
    lists = [F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("image_id", "patient_id", "case_id")]
    return rows.join(twice, "source_signature").groupBy(F.col("source_signature").alias("sha256")).agg(*lists)


@query("agg26_conflicting_bytes", f"SELECT source_signature AS sha256, count(DISTINCT patient_id) AS n_patients, count(DISTINCT case_label) AS n_labels FROM {_RAW} GROUP BY 1 HAVING count(DISTINCT patient_id) > 1 OR count(DISTINCT case_label) > 1")
def agg26(spark, sf_dir):
    return raw_hashed(spark, sf_dir).groupBy(F.col("source_signature").alias("sha256")).agg(F.countDistinct("patient_id").alias("n_patients"), F.countDistinct("case_label").alias("n_labels")).filter("n_patients > 1 OR n_labels > 1")


@query("agg27_coverage", f"SELECT c.objective_lens, count(*) AS expected, count(p.image_id) AS selected FROM {CURRENT} c LEFT JOIN {_PACKED} p USING (image_id) GROUP BY 1")
def agg27(spark, sf_dir):
    found = packed(spark, sf_dir).withColumn("found", F.lit(1))
    return current(spark, sf_dir).join(found, "image_id", "left").groupBy("objective_lens").agg(F.count("*").alias("expected"), F.count("found").alias("selected"))


_FLAGS = f"""SELECT objective_lens, bool_or(p.image_id IS NULL) AS m, bool_or(patient_id IS NULL) AS i, bool_or(case_label IS NULL) AS u, bool_or(source_signature IS NULL OR NOT regexp_full_match(source_signature, '[0-9a-f]{{64}}')) AS r, bool_or(d.sha IS NOT NULL) AS d
FROM {CURRENT} c LEFT JOIN {_PACKED} p USING (image_id) LEFT JOIN (SELECT source_signature AS sha FROM {_RAW} GROUP BY 1 HAVING count(*) > 1) d ON d.sha = c.source_signature GROUP BY 1"""
_BLOCKERS = "list_filter([CASE WHEN m THEN 'missing_source_images' END, CASE WHEN i THEN 'patient_identity_not_verified' END, CASE WHEN u THEN 'unknown_case_labels' END, CASE WHEN r THEN 'raw_sha256_pending_import_audit' END, CASE WHEN d THEN 'duplicate_raw_content_requires_review' END], lambda x: x IS NOT NULL)"


def blockers(spark, sf_dir) -> DataFrame:
    """(objective_lens, training_blockers): the named conditions that forbid training, in order."""
    dup = raw_hashed(spark, sf_dir).groupBy("source_signature").agg(F.count("*").alias("n")).filter("n > 1").select("source_signature", F.lit(True).alias("dup"))
    rows = current(spark, sf_dir).join(packed(spark, sf_dir).withColumn("found", F.lit(True)), "image_id", "left").join(dup, "source_signature", "left")
    unhashed = F.coalesce(~F.col("source_signature").rlike(r"\A[0-9a-f]{64}\z"), F.lit(True))
    flags = [("missing_source_images", F.col("found").isNull()), ("patient_identity_not_verified", F.col("patient_id").isNull()), ("unknown_case_labels", F.col("case_label").isNull()), ("raw_sha256_pending_import_audit", unhashed), ("duplicate_raw_content_requires_review", F.coalesce("dup", F.lit(False)))]
    one = rows.groupBy("objective_lens").agg(*[F.bool_or(c).alias(n) for n, c in flags])
    return one.select("objective_lens", F.array_compact(F.array(*[F.when(F.col(n), n) for n, _ in flags])).alias("training_blockers"))


@query("agg28_training_blockers", f"SELECT objective_lens, {_BLOCKERS} AS training_blockers FROM ({_FLAGS})")
def agg28(spark, sf_dir):
    return blockers(spark, sf_dir)


@query("flt20_training_gate", f"SELECT objective_lens, len({_BLOCKERS}) = 0 AS training_ready FROM ({_FLAGS})")
def flt20(spark, sf_dir):
    return blockers(spark, sf_dir).select("objective_lens", (F.size("training_blockers") == 0).alias("training_ready"))


@query("flt17_case_label_conflicts", f"SELECT case_id, count(DISTINCT coalesce(case_label, -1)) AS n_labels FROM {CURRENT} GROUP BY 1 HAVING count(DISTINCT coalesce(case_label, -1)) > 1")
def flt17(spark, sf_dir):
    return current(spark, sf_dir).groupBy("case_id").agg(F.countDistinct(F.coalesce("case_label", F.lit(-1))).alias("n_labels")).filter("n_labels > 1")


@query("flt04_lens_filter", f"SELECT objective_lens, count(*) AS n FROM {CURRENT} WHERE objective_lens IN (4, 40) GROUP BY 1")
def flt04(spark, sf_dir):
    return current(spark, sf_dir).filter(F.col("objective_lens").isin(4, 40)).groupBy("objective_lens").agg(F.count("*").alias("n"))


@query("flt11_repeated_keys", "SELECT upper(trim(image_id)) AS image_id, count(*) AS n FROM catalog_images WHERE trim(image_id) <> '' GROUP BY 1 HAVING count(*) > 1")
def flt11(spark, sf_dir):
    return read(spark, sf_dir, "catalog_images").groupBy(tidy_upper("image_id").alias("image_id")).agg(F.count("*").alias("n")).filter("n > 1 AND image_id IS NOT NULL")


_KEY = "regexp_full_match(image_id, '[A-Za-z0-9_.-]+')"


@query("flt13_catalog_rules", f"""SELECT row_no, list_filter([CASE WHEN NOT coalesce({_KEY}, false) THEN 'image_id' END, CASE WHEN NOT coalesce(byte_size > 0, false) THEN 'byte_size' END,
CASE WHEN NOT coalesce(regexp_full_match(source_signature, '[0-9a-f]{{64}}|zip-crc32:[0-9a-f]{{8}}'), false) THEN 'source_signature' END, CASE WHEN objective_lens IS NULL OR objective_lens NOT IN (4, 10, 40) THEN 'objective_lens' END], lambda x: x IS NOT NULL) AS violated FROM catalog_images""")
def flt13(spark, sf_dir):
    """The rules each entry violates, in order; an empty list is a valid entry."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    rules = [("image_id", bad(X.safe_id(F.col("image_id")))), ("byte_size", bad(F.col("byte_size") > 0)), ("source_signature", bad(F.col("source_signature").rlike(r"\A(?:[0-9a-f]{64}|zip-crc32:[0-9a-f]{8})\z"))), ("objective_lens", bad(F.col("objective_lens").isin(4, 10, 40)))]
    return read(spark, sf_dir, "catalog_images").select("row_no", F.array_compact(F.array(*[F.when(c, n) for n, c in rules])).alias("violated"))


@query("flt12_manifest_rules", """SELECT row_no, list_filter([CASE WHEN NOT coalesce(regexp_full_match(shard_id, 'shard-[0-9]{9}'), false) THEN 'shard_id' END, CASE WHEN NOT coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false) THEN 'sha256' END,
CASE WHEN NOT coalesce(byte_size > 0, false) THEN 'byte_size' END, CASE WHEN NOT coalesce(starts_with(member, 'images/'), false) THEN 'member' END, CASE WHEN image_id IS NULL OR trim(image_id) = '' THEN 'image_id' END], lambda x: x IS NOT NULL) AS violated FROM shards""")
def flt12(spark, sf_dir):
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    rules = [("shard_id", bad(F.col("shard_id").rlike(r"\Ashard-[0-9]{9}\z"))), ("sha256", bad(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"))), ("byte_size", bad(F.col("byte_size") > 0)), ("member", bad(F.col("member").startswith("images/"))), ("image_id", tidy_upper("image_id").isNull())]
    return read(spark, sf_dir, "shards").select("row_no", F.array_compact(F.array(*[F.when(c, n) for n, c in rules])).alias("violated"))


@query("flt15_label_mismatches", f"""SELECT count(*) FILTER (c.image_id IS NULL) AS not_covered, count(*) FILTER (c.objective_lens <> t.objective_lens) AS lens_differs, count(*) FILTER (c.case_label <> t.has_cancer) AS label_differs FROM tissue_detection t LEFT JOIN {CURRENT} c ON c.image_id = upper(trim(t.slide_id)) WHERE trim(t.slide_id) <> ''""")
def flt15(spark, sf_dir):
    """How tables disagree with the current metadata."""
    tiles = read(spark, sf_dir, "tissue_detection").select(tidy_upper("slide_id").alias("image_id"), F.col("objective_lens").alias("lens"), "has_cancer").filter("image_id IS NOT NULL")
    joined = tiles.join(current(spark, sf_dir).select("image_id", "objective_lens", "case_label", F.lit(True).alias("known")), "image_id", "left")
    return joined.agg(F.count_if(F.col("known").isNull()).alias("not_covered"), F.count_if(F.col("objective_lens") != F.col("lens")).alias("lens_differs"), F.count_if(F.col("case_label") != F.col("has_cancer")).alias("label_differs"))


@query("scl29_path_fallback", f"""SELECT q.row_no, coalesce(a.m, b.m, 'images/' || q.file_name) AS path FROM qc_objective_lens q
LEFT JOIN (SELECT file_name, min(source_member) AS m FROM catalog_images GROUP BY 1) a ON a.file_name = q.file_name LEFT JOIN (SELECT upper(trim(image_id)) AS i, min(source_member) AS m FROM catalog_images WHERE trim(image_id) <> '' GROUP BY 1) b ON b.i = upper(trim(q.image_id))""")
def scl29(spark, sf_dir):
    """The member by file name, else by id, else a default."""
    catalog = read(spark, sf_dir, "catalog_images")
    by_name = catalog.groupBy("file_name").agg(F.min("source_member").alias("by_name"))
    by_id = catalog.select(tidy_upper("image_id").alias("k"), "source_member").filter("k IS NOT NULL").groupBy("k").agg(F.min("source_member").alias("by_id"))
    rows = read(spark, sf_dir, "qc_objective_lens").select("row_no", "file_name", tidy_upper("image_id").alias("k"))
    return rows.join(by_name, "file_name", "left").join(by_id, "k", "left").select("row_no", F.coalesce("by_name", "by_id", F.concat(F.lit("images/"), "file_name")).alias("path"))
