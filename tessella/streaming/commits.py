"""Restartable incremental work: committed units, file streams and locked settings.

A unit of work is committed by a row in a commit table, written after its data; readers
join with it, so data of a failed attempt stay invisible. A rerun handles what has no
row yet. Streams use their own checkpoint and add the same rows, once per batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources import shared

COMMIT = T.StructType([T.StructField("unit", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("rows", T.LongType())])


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The commit table; empty when nothing was committed yet."""
    if not shared.listed(folder, ".parquet"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(folder)


def waiting(units: DataFrame, done: DataFrame, unit: str, most: int | None = None) -> DataFrame:
    """Units without a commit, in order; `most` bounds new work only."""
    todo = units.join(done.select(F.col("unit").alias(unit)).distinct(), unit, "left_anti")
    return todo if most is None else todo.orderBy(unit).limit(most)


def process_waiting(spark: SparkSession, rows: DataFrame, unit: str, data: str, commits: str, most: int | None = None) -> int:
    """Write the rows of waiting units and commit them; returns the number of new units."""
    units = rows.select(F.col(unit).cast("string").alias(unit)).distinct()
    todo = waiting(units, committed(spark, commits), unit, most)
    batch = committed(spark, commits).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] + 1
    chosen = rows.withColumn(unit, F.col(unit).cast("string")).join(todo, unit, "left_semi").withColumn("batch", F.lit(batch).cast("long"))
    counts = chosen.groupBy(F.col(unit).alias("unit"), "batch").agg(F.count("*").alias("rows"))
    listed = counts.collect() if most is not None and most <= 100_000 else None
    if listed == []:
        return 0
    chosen.write.mode("overwrite").parquet(f"{data}/batch={batch}")
    written = spark.createDataFrame(listed, COMMIT) if listed is not None else counts.select("unit", "batch", "rows")
    written.write.mode("append").parquet(commits)
    return committed(spark, commits).filter(F.col("batch") == batch).count()


def visible(spark: SparkSession, data: str, commits: str, unit: str) -> DataFrame:
    """The rows of committed units only."""
    rows = spark.read.option("basePath", data).parquet(data)
    return rows.join(committed(spark, commits).select(F.col("unit").alias(unit), F.col("batch").cast("int").alias("batch")), [unit, "batch"], "left_semi")


def run_available(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 1, file_format: str = "parquet") -> int:
    """Handle the files that arrived since the last run, batch by batch, and stop."""
    handled = []

    def each(batch: DataFrame, number: int) -> None:
        handle(batch, number)
        handled.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(source)
    started = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return len(handled)


def _canonical(settings: dict) -> bytes:
    """One text for equal settings; made on the driver, since they may hold floats."""
    return json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def settings_id(settings: dict) -> str:
    """SHA-256 of the canonical JSON of settings."""
    return hashlib.sha256(_canonical(settings)).hexdigest()


def lock_settings(folder: str, settings: dict) -> str:
    """Keep a folder to the settings it was made with first, and return their id; other ones are an error."""
    place, text = shared.joined(folder, "_settings.json"), _canonical(settings)
    if (shared.content(place) if shared.exists(place) else text) != text:
        raise ValueError(f"{folder} was made with other settings")
    shared.put(place, [text])
    return settings_id(settings)


def same_assignment(saved: DataFrame, wanted: DataFrame) -> bool:
    """Whether two split assignments are equal."""
    return saved.exceptAll(wanted).isEmpty() and wanted.exceptAll(saved).isEmpty()
