"""Tables and inventories from files: text tables, JSON, image folders, several sources."""

from __future__ import annotations

import csv
import io
import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources import archives, shared, sheets
from tessella.sources.archives import IMAGE_SUFFIXES


#: Files up to this number are read by name, more by folder.
LISTED = 10_000


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or XLSX table, every column a string and blanks ''."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        sheets.register(spark)
        return spark.read.format("xlsx").load(path)
    with shared.seekable(path) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="") as file:
        names = next(csv.reader(file), [])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with types found in its values; blanks are null."""
    return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table with a declared schema; a value that does not fit is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line with a declared schema; a bad line is an error that names its file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_object(path: str) -> dict:
    """One JSON object; anything else is an error."""
    value = json.loads(shared.content(path))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not an object")
    return value


def configured(path: str | None, section: str, given: dict, defaults: dict) -> dict:
    """Defaults, then a section of a JSON file, then what was given; unknown keys are errors."""
    stored = read_object(path).get(section, {}) if path else {}
    unknown = (set(stored) | set(given)) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | stored | {k: v for k, v in given.items() if v is not None}


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?\z", 1)


def image_files(spark: SparkSession, folder: str, recursive: bool = True, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, source_member, file_name, stem, byte_size) of the images below a folder.

    Contents are not read: only path and length are selected from the file source.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    kept = rows.filter(F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z"))
    root = os.path.abspath(folder.removeprefix("file:"))
    member = F.regexp_replace("path", r"\Afile:/+" + root.strip("/").replace(".", r"\.") + "/", "")
    return kept.select("path", member.alias("source_member"), name.alias("file_name"), _stem(name).alias("stem"), F.col("length").alias("byte_size"))


def flat_by_stem(files: DataFrame) -> DataFrame:
    """One path of each stem, the last in order."""
    return files.groupBy("stem").agg(F.max("path").alias("path"))


def selected_sources(folder: str | None, archives_in: str | None) -> list[tuple[str, str, str]]:
    """(source_id, kind, path): the folder, if there is one, and the ZIP files, sorted."""
    paths = [("directory", folder)] if folder and os.path.isdir(folder) else []
    if archives_in and os.path.isdir(archives_in):
        paths += [("zip", os.path.join(archives_in, n)) for n in sorted(os.listdir(archives_in)) if n.lower().endswith(".zip")]
    return [(f"source-{i:03d}", kind, path) for i, (kind, path) in enumerate(paths)]


def inventory(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """(source_id, source_member, file_name, byte_size, source_signature) over all sources.

    A directory's files have no signature yet; they are hashed once they are selected.
    A file name in two places is an error.
    """
    archives.register(spark)
    parts = []
    for source_id, kind, path in sources:
        rows = image_files(spark, path).withColumn("source_signature", F.lit(None).cast("string")) if kind == "directory" else spark.read.format("zip_inventory").load(path)
        parts.append(rows.select(F.lit(source_id).alias("source_id"), "source_member", "file_name", "byte_size", "source_signature"))
    if not parts:
        raise ValueError("no image sources")
    rows = reduce(DataFrame.unionByName, parts)
    twice = rows.groupBy("file_name").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"file names in several places: {[r.file_name for r in twice]}")
    return rows


def hashed(spark: SparkSession, paths: DataFrame, folders: list[str], listed: int = LISTED) -> DataFrame:
    """(path, sha256) of selected files.

    Up to `listed` files are read by name, so no other content is touched; more are read
    by folder and joined, since a long list of names would have to pass the driver.
    """
    names = [r.path for r in paths.select("path").limit(listed + 1).collect()]
    if not names:
        return spark.createDataFrame([], "path string, sha256 string")
    if len(names) <= listed:
        return spark.read.format("binaryFile").load(names).select("path", F.sha2("content", 256).alias("sha256"))
    plain = lambda c: F.regexp_replace(c, r"\Afile:/+", "/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path", F.sha2("content", 256).alias("sha256"))
    return rows.join(paths.select(plain("path").alias("wanted")), plain(F.col("path")) == F.col("wanted"), "left_semi")


def safe_children(listing: DataFrame, parent: str, child: str, name: str) -> DataFrame:
    """(parent, child, name, problem): defects of a folder tree listing, null when there is none."""
    repeats = listing.groupBy(parent, name).agg(F.count("*").alias("n"))
    problem = F.when(F.col(parent) == F.col(child), "cycle").when(F.col(name).rlike(r"[\\/:]") | F.col(name).isin("", ".", ".."), "unsafe name").when(F.col("n") > 1, "name twice")
    return listing.join(repeats, [parent, name]).select(parent, child, name, problem.alias("problem"))


def to_download(listing: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files that are absent here or differ in size or checksum."""
    return listing.join(local.select("path", "size", "md5"), ["path", "size", "md5"], "left_anti")
