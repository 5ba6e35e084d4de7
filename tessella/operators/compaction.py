"""Consolidation of very many small files into few of good size.

Steps: freeze a manifest of the files, pack them into bins by first-fit decreasing,
rewrite each bin, verify row counts and checksums, and commit by one atomic rename.

Defined cases: a record listed twice counts once (the smallest number stays). A file
without a name is not packed. A file of unknown size is packed with `unknown_bytes`.
Files of at least the threshold are left alone; equal sizes are packed in key order.
An empty input gives no bins and an empty, committed output.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import tar_record_bytes
from tessella.operators.packing import numbered
from tessella.sources import archives, shared, sinks

#: Tars below this are too small.
SMALL_TAR_BYTES = 4_194_304
#: Size that a consolidated file should reach.
TARGET_BYTES = 134_217_728
#: Size at which a file of unknown size is packed.
UNKNOWN_BYTES = 65_536
#: Files packed by one task; a task's bins are full but for at most a few.
CHUNK_FILES = 100_000


def tar_members(members: DataFrame, tar: Column, member: Column, size: Column) -> DataFrame:
    """(tar, member, size): a member counts once per tar with its largest known size."""
    each = members.select(tar.alias("tar"), member.alias("member"), size.cast("long").alias("size")).filter("tar IS NOT NULL")
    return each.groupBy("tar", "member").agg(F.max("size").alias("size"))


def tar_sizes(members: DataFrame, tar: Column, member: Column, size: Column) -> DataFrame:
    """(tar, bytes, members) by `tar_members`."""
    each = tar_members(members, tar, member, size)
    return each.groupBy("tar").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("members"))


def repeated_paths(files: DataFrame) -> DataFrame:
    """(path, first): the paths of `files` (no, path) that several rows name, and the smallest number."""
    named = files.select("no", "path").filter("path IS NOT NULL")
    return named.groupBy("path").agg(F.min("no").alias("first"), F.count("*").alias("n")).filter("n > 1").select("path", "first")


def freeze_manifest(tiles: DataFrame, tile_no: Column, tile_path: Column, tile_bytes: Column, members: DataFrame, tar: Column, member: Column, member_bytes: Column, small_bytes: int = SMALL_TAR_BYTES) -> DataFrame:
    """(file_kind, file_key, bytes, action): what is to be done with each file.

    action: `pack` for a file to be regrouped, `keep` for one of good size, `drop` for
    a row that names a file already listed. Only paths that occur more than once are
    joined back, so that join's other side is as small as the repetitions.
    """
    listed = tiles.select(tile_no.alias("no"), tile_path.alias("path"), tile_bytes.cast("long").alias("bytes")).filter("path IS NOT NULL")
    listed = listed.join(repeated_paths(listed), "path", "left")
    action = F.when(F.col("no") > F.col("first"), "drop").when(F.col("bytes") >= small_bytes, "keep").otherwise("pack")
    tile_rows = listed.select(F.lit("tile").alias("file_kind"), F.col("no").cast("string").alias("file_key"), "bytes", action.alias("action"))
    tars = tar_sizes(members, tar, member, member_bytes)
    tar_rows = tars.select(F.lit("tar").alias("file_kind"), F.col("tar").alias("file_key"), "bytes", F.when(F.col("bytes") < small_bytes, "pack").otherwise("keep").alias("action"))
    return tar_rows.unionByName(tile_rows)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin numbers of `sizes`, which come in descending order.

    A tournament tree over the bins' free room finds the first bin that fits in
    O(log bins). What exceeds the capacity gets a bin of its own.
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [0] * width + [capacity] * width  # leaves are unopened bins
    for node in range(width - 1, 0, -1):
        room[node] = capacity
    out = []
    for size in sizes:
        node, want = 1, min(size, capacity)
        while node < width:
            node *= 2
            if room[node] < want:
                node += 1
        out.append(node - width)
        room[node] -= want
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left > right else right
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return out


def pack_bins(files: DataFrame, kind: str, key: str, size: str, target_bytes: int = TARGET_BYTES, unknown_bytes: int = UNKNOWN_BYTES, chunk_files: int = CHUNK_FILES) -> DataFrame:
    """(kind, key, bytes, bin): each file in one bin of at most `target_bytes`.

    Files are dealt by key hash into chunks of about `chunk_files`; first-fit
    decreasing runs within each, one task per chunk, so neither the driver nor one task
    ever sees all files. The price is at most one badly filled bin a chunk.
    """
    chosen = files.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(unknown_bytes)).alias("bytes")).filter("key IS NOT NULL")
    chunks = max(1, -(-chosen.count() // chunk_files))
    dealt = chosen.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        bins = first_fit_decreasing(part["bytes"].tolist(), target_bytes)
        name = part["kind"].iloc[0]
        number = part["chunk"].iloc[0]
        return pd.DataFrame({"kind": part["kind"], "key": part["key"], "bytes": part["bytes"], "bin": [f"{name}-{number:06d}-{b:06d}" for b in bins]})

    return dealt.groupBy("kind", "chunk").applyInPandas(pack, "kind string, key string, bytes long, bin string")


def checksum(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows and an order-free checksum over all columns, in all or by some columns."""
    by = by or []
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in by])
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def _listing(spark: SparkSession, source: str) -> DataFrame:
    """(key, bytes, modified) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    return files.select(F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"))


def compact_parquet(spark: SparkSession, source: str, target: str, target_bytes: int = TARGET_BYTES, chunk_files: int = CHUNK_FILES) -> dict:
    """Rewrite the Parquet files below `source` as few files in the new folder `target`.

    The manifest is listed once, written beside the target, and decides what is read:
    files that come later are left out. Neither the list nor the bins pass through the
    driver. Columns are those of all files together, null where a file has none; files
    whose types do not go together are an error. Each bin becomes one file; rows and
    checksums of all bins are compared with the sums of their source files, the files are
    listed again, and only then the folder is renamed into place, with manifest and bins
    in it. Before that nothing is visible; a failed run leaves nothing. Returns the
    counts. Fails when the target exists, the data do not agree, or a listed file was
    removed or changed before the end.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(hadoop.Path(target)):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        _listing(spark, source).withColumn("kind", F.lit("file")).write.parquet(f"{staging}/_manifest")
        manifest = spark.read.parquet(f"{staging}/_manifest")
        files, total = manifest.count(), 0
        n_bins = 0
        if files:
            packed = pack_bins(manifest, "kind", "key", "bytes", target_bytes, chunk_files=chunk_files)
            packed.select("key", "bin").write.parquet(f"{staging}/_bins")
            bins = spark.read.parquet(f"{staging}/_bins")
            numbers = numbered(bins.select("bin").distinct(), ["bin"], "number")
            n_bins = numbers.count()
            placed = bins.join(numbers, "bin").select(F.col("key").alias("__file"), F.col("number").cast("int").alias("__bin"))
            rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(source)
            named = rows.withColumn("__file", F.col("_metadata.file_path"))
            tagged = named.join(placed, "__file").drop("__file")
            tagged.repartitionById(n_bins, F.col("__bin")).drop("__bin").write.mode("append").parquet(staging)
            by_file = placed.join(checksum(named, ["__file"]), "__file", "left").filter("rows IS NOT NULL")
            before = by_file.groupBy("__bin").agg(F.sum("rows").alias("rows"), F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("digest")).select("rows", "digest")
            written = spark.read.parquet(staging).select(*rows.columns, F.col("_metadata.file_path").alias("__file"))
            after = checksum(written, ["__file"]).select("rows", "digest")
            if not before.exceptAll(after).isEmpty() or not after.exceptAll(before).isEmpty():
                raise RuntimeError("what was written does not agree with the source")
            lost = manifest.join(_listing(spark, source), ["key", "bytes", "modified"], "left_anti").count()
            if lost:
                raise RuntimeError(f"{lost} of the listed files were removed or changed during the run")
            total = after.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        summary = {"files_in": files, "files_out": n_bins, "rows": total}
        stream = system.create(hadoop.Path(f"{staging}/_summary.json"), True)
        stream.write(bytearray(json.dumps(summary, sort_keys=True).encode()))
        stream.close()
        if not system.rename(hadoop.Path(staging), hadoop.Path(target)):
            raise OSError(f"{staging} could not be renamed")
    except BaseException:
        system.delete(hadoop.Path(staging), True)
        raise
    return summary


def _members(spark: SparkSession, tiles: str | None, tars: str | None) -> DataFrame:
    """(kind, file, member, content) of every tile file and of every member of every TAR.

    The new member's name is the tile's path below its folder, or the TAR's name and the
    member's.
    """
    archives.register(spark)
    parts = []
    if tiles:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tiles).select("path", "content")
        root = F.lit(shared.opened(tiles)[1].strip("/") + "/")
        below = F.regexp_replace("path", F.concat(F.lit(r"\A.*?\Q"), root, F.lit(r"\E")), F.lit(""))
        parts.append(rows.select(F.lit("tile").alias("kind"), F.col("path").alias("file"), below.alias("member"), "content"))
    if tars:
        rows = spark.read.format("tar_members").load(tars).select("archive", "member", "content")
        stem = F.regexp_extract("archive", r"([^/]+?)(?:\.tar)?\z", 1)
        parts.append(rows.select(F.lit("tar").alias("kind"), F.col("archive").alias("file"), F.concat_ws("/", stem, "member").alias("member"), F.col("content").cast("binary").alias("content")))
    return reduce(DataFrame.unionByName, parts)


def consolidate_files(spark: SparkSession, tiles: str | None, tars: str | None, target: str, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_TAR_BYTES, chunk_files: int = CHUNK_FILES) -> dict:
    """Rewrite tile files and small TARs as few TARs of good size in the new folder `target`.

    The manifest has the size and digest of every tile and of every member of every TAR;
    it is written first and decides what must come out. Files of at least `small_bytes`
    are left where they are. Files are packed first-fit decreasing by the bytes they take
    in an archive, each bin is streamed into one TAR, ordered by file and member, and the
    TARs are read back: names, sizes and digests must be those of the manifest, each once.
    Only then the folder is renamed into place, with manifest and bins in it. A file that
    is lost or replaced during the run is a difference, so the run fails and leaves
    nothing. A member name that comes from two files is an error; a file without a byte
    holds no record and stays where it is. Returns the counts.
    """
    if shared.exists(target):
        raise FileExistsError(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        found = _members(spark, tiles, tars)
        found.select("kind", "file", "member", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).write.parquet(f"{staging}/_manifest")
        manifest = spark.read.parquet(f"{staging}/_manifest")
        sizes = manifest.groupBy("kind", "file").agg(F.sum("bytes").alias("bytes"), F.sum(tar_record_bytes(F.col("member"), F.col("bytes"))).cast("long").alias("taken"))
        small = sizes.filter(F.col("bytes") < small_bytes)
        packed = pack_bins(small.withColumn("kind", F.lit("bin")), "kind", "file", "taken", target_bytes, chunk_files=chunk_files)
        packed.select(F.col("key").alias("file"), "bin").write.parquet(f"{staging}/_bins")
        bins = spark.read.parquet(f"{staging}/_bins")
        records = _members(spark, tiles, tars).join(bins, "file")
        place = F.concat_ws("\n", "file", "member")
        written = sinks.write_shards(records.select(F.col("bin").alias("shard_id"), place.alias("place"), "member", "content"), f"{staging}/tars")
        written.write.parquet(f"{staging}/_tars")
        wanted = manifest.join(bins, "file").select("bin", "member", "bytes", "sha256")
        stem = F.regexp_extract("archive", r"([^/]+)\.tar\z", 1)
        back = spark.read.format("tar_members").load(f"{staging}/tars").select(stem.alias("bin"), "member", F.col("byte_size").alias("bytes"), "sha256")
        if not wanted.exceptAll(back).isEmpty() or not back.exceptAll(wanted).isEmpty():
            raise RuntimeError("what was written does not agree with the manifest")
        made = spark.read.parquet(f"{staging}/_tars").agg(F.count("*").alias("n"), F.coalesce(F.sum("members"), F.lit(0)).alias("members")).first()
        summary = {"files_in": bins.count(), "files_kept": sizes.count() - bins.count(), "files_out": made.n, "members": made.members}
        sinks.atomic_json(f"{staging}/_summary.json", summary)
        shared.rename(staging, target)
    except BaseException:
        shared.remove(staging)
        raise
    return summary
