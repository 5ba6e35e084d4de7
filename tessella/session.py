"""Session factory, table access and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.sources import shared

#: Tables of the test data; everything is read with these names.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "catalog_images", "shards", "processing", "qc_objective_lens",
    "tissue_detection", "slide_patient_map", "patient_level_split", "patient_level_cv",
    "image_sources", "lens_targets", "mix_targets",
)


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the engine's results rely on (UTC, ANSI, adaptive plans)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(master).appName("tessella")
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory; columns are pruned by what the plan selects."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, which all executors share.

    Only a local session without such a setting gets a temporary one; elsewhere that is
    an error, since a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder for what plans store there; deleted when the driver ends."""
    folder = shared.joined(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")
    atexit.register(_forget, folder)
    return folder


def _forget(folder: str) -> None:
    with contextlib.suppress(OSError):
        shared.remove(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
