"""From a metadata table and image sources to a catalog, shards, quality rows and tiles."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import pixels as P
from tessella.functions import text as X
from tessella.operators import imaging
from tessella.operators import validation as V
from tessella.operators.packing import numbered, plan_shards
from tessella.operators.splitting import balanced_sample
from tessella.schemas import CATALOG_IMAGE
from tessella.sources import archives, files, shared, sinks
from tessella.streaming.commits import settings_id

#: Columns of a metadata table (fixed names).
METADATA = ["Ten_File", "Ma_Nam", "Ma_So", "Do_Phong_Dai", "Glade", "Ket_Luan", "Ten_Slide"]
#: Lenses of a catalog.
LENSES = (4, 10, 40)
_SHA = r"\A[0-9a-f]{64}\z"
#: Most raw pixel bytes of the patches in one archive; a patch larger than that gets its own.
PATCH_BYTES = 67_108_864


def described(metadata: DataFrame, lenses: tuple[int, ...] = LENSES) -> DataFrame:
    """Checked metadata rows of the wanted lenses with case ids and weak labels."""
    V.require_columns(metadata, METADATA, "metadata")
    rows = metadata.select(*[X.clean(F.col(c)).alias(c) for c in METADATA])
    rows = rows.withColumn("lens", X.catalog_lens(F.col("Do_Phong_Dai"))).withColumn("image_id", X.file_stem(F.col("Ten_File")))
    V.require_none(rows, ~X.safe_member(F.col("Ten_File")) | F.col("Ten_File").contains("/"), "unsafe file names", "Ten_File")
    V.require_none(rows, F.col("lens").isNull(), "unknown lenses", "Do_Phong_Dai")
    V.require_unique(rows, ["Ten_File"], "metadata")
    chosen = rows.filter(F.col("lens").isin(*lenses)).withColumn("case_id", X.case_id(F.col("Ma_Nam"), F.col("Ma_So")))
    V.require_none(chosen, F.col("case_id").isNull(), "rows without a case", "Ten_File")
    V.require_none(chosen, ~X.safe_id(F.col("image_id")), "unsafe image ids", "image_id")
    return chosen.withColumn("case_label", X.report_label(F.col("Ket_Luan")))


def build_catalog(spark: SparkSession, metadata: str, sources: list[tuple[str, str, str]], identities: str | None = None, lenses: tuple[int, ...] = LENSES, per_lens: int | None = None, reviewed: bool = False) -> tuple[DataFrame, dict]:
    """The catalog's images and its header.

    Only images that are chosen are hashed. The header has the coverage per lens, the
    blockers and an id that depends on the images' records, not on where they lie.
    """
    rows = described(files.read_strings(spark, metadata), lenses)
    inventory = files.inventory(spark, sources)
    known = spark.createDataFrame([], "case_id string, patient_id string")
    if identities:
        table = V.require_columns(files.read_strings(spark, identities), ["case_id", "patient_id"], "identities")
        known = V.require_unique(table.select(F.upper(F.regexp_replace(X.clean(F.col("case_id")), r"(?U)\s+", "")).alias("case_id"), X.clean(F.col("patient_id")).alias("patient_id")), ["case_id"], "identities")
        V.require_none(known, "patient_id = ''", "cases without a patient", "case_id")
    found = rows.join(inventory, rows["Ten_File"] == inventory["file_name"]).join(known, "case_id", "left")
    images = found.select(
        "source_id", "source_member", "file_name", "byte_size", "source_signature", "image_id", F.col("lens").alias("objective_lens"), "case_id", "patient_id", F.col("Ten_Slide").alias("slide_group_id"), F.col("Glade").alias("raw_glade"),
        F.lit("unconfirmed").alias("grade_semantics"), "case_label", F.lit("case").alias("label_level"), F.lit("Ket_Luan").alias("label_source"), F.when(F.col("patient_id").isNull(), "candidate_case").otherwise("verified_mapping").alias("identity_status"))
    if per_lens is not None:
        images = balanced_sample(images, "objective_lens", "case_label", "case_id", "image_id", per_lens).drop("place")
    V.require_unique(images, ["image_id"], "catalog")
    folders = [(s, os.path.abspath(p)) for s, kind, p in sources if kind == "directory"]
    if folders:
        places = spark.createDataFrame(folders, "source_id string, folder string")
        unhashed = images.filter("source_signature IS NULL").join(places, "source_id").select("image_id", F.concat_ws("/", "folder", "source_member").alias("path"))
        digests = files.hashed(spark, unhashed, [p for _, p in folders]).select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), "sha256")
        images = images.join(unhashed.join(digests, "path").select("image_id", "sha256"), "image_id", "left").withColumn("source_signature", F.coalesce("source_signature", "sha256")).drop("sha256")
    images = images.select(*[f.name for f in CATALOG_IMAGE.fields])
    conflicts = images.groupBy("case_id").agg(F.countDistinct(F.coalesce("case_label", F.lit(-1))).alias("n"))
    V.require_none(conflicts, "n > 1", "cases with different labels", "case_id")
    expected = {r.lens: r.n for r in rows.groupBy("lens").agg(F.count("*").alias("n")).collect()}
    selected = {r.objective_lens: r.n for r in images.groupBy("objective_lens").agg(F.count("*").alias("n")).collect()}
    for lens in lenses:
        if not selected.get(lens):
            raise ValueError(f"no images of {lens}X")
    missing = rows.join(inventory, rows["Ten_File"] == inventory["file_name"], "left_anti").count()
    hashed = F.col("source_signature").rlike(_SHA)
    repeated = images.filter(hashed).groupBy("source_signature").count().filter("count > 1")
    flags = images.agg(F.coalesce(F.bool_or(F.col("patient_id").isNull()), F.lit(False)).alias("a"), F.coalesce(F.bool_or(F.col("case_label").isNull()), F.lit(False)).alias("b"), F.coalesce(F.bool_or(~hashed), F.lit(False)).alias("c")).first()
    blockers = [name for name, on in (("smoke_subset", per_lens is not None), ("missing_source_images", missing > 0), ("case_labels_not_reviewed", not reviewed), ("patient_identity_not_verified", flags.a), ("unknown_case_labels", flags.b), ("raw_sha256_pending_import_audit", flags.c), ("duplicate_raw_content_requires_review", not repeated.isEmpty())) if on]
    header = {"mode": "full" if per_lens is None else "smoke", "missing_images": missing, "labels_reviewed": reviewed, "training_blockers": blockers, "training_ready": not blockers, "coverage": {str(x): {"expected": expected.get(x, 0), "selected": selected[x]} for x in lenses}}
    header["catalog_id"] = _catalog_id(images, header)
    return images, header


def _catalog_id(images: DataFrame, header: dict) -> str:
    """An id from the records in any order: their digests are summed, not gathered."""
    digest = F.sha2(F.to_json(F.struct(*sorted(images.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    sums = images.agg(F.count("*"), *parts).first()
    return hashlib.sha256(json.dumps([list(map(str, sums)), header], sort_keys=True).encode()).hexdigest()


def contents(spark: SparkSession, images: DataFrame, sources: list[tuple[str, str, str]]) -> DataFrame:
    """(image_id, content) of the given images, each read from its own source."""
    archives.register(spark)
    parts = []
    for source_id, kind, path in sources:
        own = images.filter(F.col("source_id") == source_id).select("image_id", "source_member")
        if kind == "directory":
            names = [r.source_member for r in own.select("source_member").limit(files.LISTED + 1).collect()]
            if not names:
                continue
            few = len(names) <= files.LISTED  # then nothing but these files is read
            rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([shared.joined(path, n) for n in names] if few else path)
            root = os.path.abspath(path).strip("/").replace(".", r"\.")
            rows = rows.select(F.regexp_replace("path", r"\Afile:/+" + root + "/", "").alias("source_member"), "content")
        else:
            rows = spark.read.format("zip_members").load(path).select(F.col("member").alias("source_member"), "content")
        parts.append(own.join(rows, "source_member").select("image_id", "content"))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "image_id string, content binary"))


def prepare(spark: SparkSession, metadata: str, sources: list[tuple[str, str, str]], out: str, cap: int = 536_870_912, max_shards: int | None = None, **options) -> dict:
    """Write the catalog, and as many of its shards as asked for; a rerun goes on where it stopped.

    A shard counts once its row is in release.json, which is replaced atomically; the
    folder is bound to one catalog. Returns the release.
    """
    shared.make_folder(out)
    images, header = build_catalog(spark, metadata, sources, **options)
    release_path = shared.joined(out, "release.json")
    release = {"catalog_id": header["catalog_id"], "max_bytes": cap, "complete": False, "shards": []}
    if shared.exists(release_path):
        old = files.read_object(release_path)
        if (old["catalog_id"], old["max_bytes"]) != (header["catalog_id"], cap):
            raise ValueError(f"{out} holds another catalog or another size of shards")
        for s in old["shards"]:
            if sinks.digest(shared.joined(out, s["tar_name"])) != s["tar_sha256"]:
                raise ValueError(f"{s['tar_name']} was changed")
        release = old
    catalog = shared.joined(out, "catalog")
    if not shared.exists(shared.joined(catalog, "_SUCCESS")):
        images.write.mode("overwrite").parquet(catalog)
        sinks.atomic_json(shared.joined(out, "catalog.json"), header)
    images = spark.read.parquet(catalog)
    member = X.output_member(F.col("image_id"), F.col("file_name"))
    planned = plan_shards(images.select("image_id", "objective_lens", "case_id", member.alias("member"), X.tar_record_bytes(member, F.col("byte_size")).cast("long").alias("record_bytes")), "objective_lens", ["case_id", "image_id"], "record_bytes", cap)
    groups = planned.select("objective_lens", "shard_no").distinct()
    names = numbered(groups, ["objective_lens", "shard_no"]).withColumn("shard_id", F.format_string("shard-%09d", "position")).drop("position")
    done = spark.createDataFrame([(s["shard_id"],) for s in release["shards"]], "shard_id string")
    waiting = names.join(done, "shard_id", "left_anti")
    waiting = waiting if max_shards is None else waiting.orderBy("shard_id").limit(max_shards)
    if not waiting.isEmpty():
        place = F.row_number().over(W.partitionBy("shard_id").orderBy("case_id", "image_id"))
        wanted = planned.join(waiting, ["objective_lens", "shard_no"]).withColumn("place", place)
        records = wanted.join(contents(spark, images.join(wanted.select("image_id"), "image_id", "left_semi"), sources), "image_id")
        written = sinks.write_shards(records.select("shard_id", "place", "member", "content"), out).collect()
        release["shards"] = sorted(release["shards"] + [r.asDict() for r in written], key=lambda s: s["shard_id"])
    release["complete"] = len(release["shards"]) == names.count()
    sinks.atomic_json(release_path, release)
    return release


def verify(spark: SparkSession, out: str) -> int:
    """Compare the release's archives with their digests and the catalog; returns the number of images."""
    release = files.read_object(shared.joined(out, "release.json"))
    for s in release["shards"]:
        if sinks.digest(shared.joined(out, s["tar_name"])) != s["tar_sha256"]:
            raise ValueError(f"{s['tar_name']} was changed")
    if not release["shards"]:
        return 0
    archives.register(spark)
    members = spark.read.format("tar_members").load(out).select("member", "byte_size")
    images = spark.read.parquet(shared.joined(out, "catalog")).select(X.output_member(F.col("image_id"), F.col("file_name")).alias("member"), F.col("byte_size").alias("wanted"))
    joined = members.join(images, "member", "left")
    V.require_unique(members, ["member"], "release")
    V.require_none(joined, F.col("wanted").isNull() | (F.col("wanted") != F.col("byte_size")), "members that differ from the catalog", "member")
    n = members.count()
    if release["complete"] and n != images.count():
        raise ValueError("a complete release lacks images")
    return n


def _altered(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """The archives whose bytes no longer have the digest they were written with."""
    for batch in batches:
        found = [shared.digest(p) if shared.exists(p := shared.joined(folder, n)) else None for n in batch["tar_name"]]
        yield batch.assign(found=found)[["tar_name", "tar_sha256", "found"]]


def verify_output(spark: SparkSession, folder: str) -> dict:
    """Check what `process` published: archives, patches, ids, geometry and counts. Returns its commit."""
    commit = files.read_object(shared.joined(folder, "commit.json"))
    at = lambda name: shared.joined(folder, name)
    written = spark.read.parquet(at("patch_archives"))
    digests = written.select("tar_name", "tar_sha256").mapInPandas(lambda b: _altered(b, at("patches")), "tar_name string, tar_sha256 string, found string")
    V.require_none(digests, ~F.col("found").eqNullSafe(F.col("tar_sha256")), "archives that were changed", "tar_name")
    tiles = spark.read.parquet(at("tiles"))
    archives.register(spark)
    members = spark.read.format("tar_members").load(at("patches")).select("member", "sha256")
    both = tiles.select("patch_member", F.sha2("png", 256).alias("wanted")).join(members, F.col("patch_member") == F.col("member"), "full")
    V.require_none(both.withColumn("name", F.coalesce("member", "patch_member")), ~F.col("wanted").eqNullSafe(F.col("sha256")), "patches that differ from the tiles", "name")
    V.require_unique(tiles, ["tile_id"], "tiles")
    rules = ~F.col("tile_id").rlike(_SHA) | (F.col("patch_member") != F.concat(F.lit("patches/"), "tile_id", F.lit(".png"))) | (F.least("x", "y") < 0) | (F.least("valid_w", "valid_h") < 1) | (F.col("valid_w") > F.col("w")) | (F.col("valid_h") > F.col("h"))
    V.require_none(tiles, rules, "tiles with wrong ids or geometry", "tile_id")
    quality = spark.read.parquet(at("quality"))
    counts = {"images": quality.count(), "tiles": tiles.count(), "members": written.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]}
    if counts != {"images": commit["images"], "tiles": commit["tiles"], "members": commit["tiles"]}:
        raise ValueError(f"{folder}: {counts} where the commit has {commit['images']} images and {commit['tiles']} tiles")
    wrong = quality.join(tiles.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left").filter(F.col("tiles_written") != F.coalesce("n", F.lit(0)))
    V.require_none(wrong, F.lit(True), "images with other numbers of tiles", "image_id")
    return commit


def process(spark: SparkSession, folder: str, out: str, settings: P.Settings | None = None) -> dict:
    """Quality rows, tiles and archives of their PNG patches, published by one rename and a commit file.

    The output is named by its settings and the images' digests; when it is there
    already, it is verified and reused. One that was changed is an error.
    """
    settings = settings or P.Settings()
    listed = files.image_files(spark, folder)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    digests = whole.select("path", F.sha2("content", 256).alias("sha256"))
    V.require_none(imaging.several_frames(whole), F.lit(True), "files with several pictures", "path")
    facts = listed.join(digests, "path").select(F.col("stem").alias("image_id"), "sha256")
    V.require_unique(facts, ["image_id"], "images")
    config = settings_id(vars(settings))
    total = facts.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "image_id", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("s")).first()
    name = hashlib.sha256(f"{config}|patches|{total.n}|{total.s}".encode()).hexdigest()[:32]
    final = shared.joined(out, name)
    if shared.exists(shared.joined(final, "commit.json")):
        return {**verify_output(spark, final), "reused": True}
    staging = shared.joined(out, f".{name}.staging")
    twice = facts.groupBy("sha256").agg(F.sort_array(F.collect_set("image_id")).alias("ids")).filter(F.size("ids") > 1)
    frames = imaging.images(spark, folder)
    rows = imaging.quality(frames, settings, strict=True).join(facts, "image_id").join(twice, "sha256", "left")
    others = F.coalesce(F.array_remove("ids", F.col("image_id")), F.array().cast("array<string>"))
    reasons = imaging.review_reasons(F.col("tissue_fraction"), F.size(others) > 0, F.col("focus_score"), F.col("tiles_eligible"), settings.blur_threshold)
    written = F.least("tiles_eligible", F.lit(settings.max_tiles)) if settings.max_tiles else F.col("tiles_eligible")
    rows = rows.select("image_id", F.col("sha256").alias("source_sha256"), (F.size(others) > 0).alias("duplicate_source_content"), others.alias("duplicate_source_image_ids"), "background_reference_rgb", "width", "height", "decode_ok", "tissue_fraction", "focus_score", "tiles_eligible", written.alias("tiles_written"), F.when(F.size(reasons) > 0, "review").otherwise("pass").alias("status"), reasons.alias("reasons"))
    rows.write.mode("overwrite").parquet(shared.joined(staging, "quality"))
    tiles = imaging.tile_ids(imaging.tiles(frames, settings).join(facts, "image_id"), F.col("sha256"), config)
    tiles.withColumnRenamed("sha256", "source_sha256").write.mode("overwrite").parquet(shared.joined(staging, "tiles"))
    quality = spark.read.parquet(shared.joined(staging, "quality"))
    stats = quality.agg(F.count("*").alias("images"), F.coalesce(F.sum("tiles_written"), F.lit(0)).alias("tiles"), F.count_if(F.col("status") == "review").alias("review"), F.count_if("duplicate_source_content").alias("duplicates")).first().asDict()
    tiles = spark.read.parquet(shared.joined(staging, "tiles"))
    n_tiles = tiles.count()
    if n_tiles != stats["tiles"]:
        raise RuntimeError(f"{n_tiles} tiles written, {stats['tiles']} counted")
    shared.remove(shared.joined(staging, "patches"))
    each = max(1, PATCH_BYTES // (3 * settings.tile_size**2))
    part = F.floor((F.col("place") - 1) / each).cast("int")
    shard = F.concat(F.lit("patches-"), F.substring(F.sha2("image_id", 256), 1, 32), F.format_string("-%06d", part))
    patches = sinks.write_shards(tiles.select(shard.alias("shard_id"), "place", F.col("patch_member").alias("member"), F.col("png").alias("content")), shared.joined(staging, "patches"))
    patches.write.mode("overwrite").parquet(shared.joined(staging, "patch_archives"))
    n_patches = spark.read.parquet(shared.joined(staging, "patch_archives")).agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    if n_patches != n_tiles:
        raise RuntimeError(f"{n_patches} patches written, {n_tiles} tiles")
    commit = {"processing_id": name, "config_id": config, **stats, "mode": "smoke" if settings.max_tiles else "full"}
    sinks.atomic_json(shared.joined(staging, "commit.json"), commit)
    shared.rename(staging, final)
    return {**commit, "reused": False}
