"""Checks that stop a run: required columns, rows, keys and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    """The frame, or an error that names the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: columns missing: {missing}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """The frame, or an error with some keys that occur twice."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{what}: keys twice: {[tuple(r[k] for k in keys) for r in twice]}")
    return df


def require_none(df: DataFrame, condition, what: str, show: str) -> DataFrame:
    """The frame, or an error with some rows that meet the condition."""
    bad = df.filter(condition).select(show).limit(5).collect()
    if bad:
        raise ValueError(f"{what}: {[r[0] for r in bad]}")
    return df


def require_patients(df: DataFrame, patient: str, label: str, what: str = "data") -> DataFrame:
    """Binary labels, no blank patients, both classes among patients; one aggregate decides."""
    found = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim(patient), F.lit("")) == "").alias("blank"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("odd")).first()
    if not found.n:
        raise ValueError(f"{what}: no rows")
    if found.blank or found.odd:
        raise ValueError(f"{what}: {found.blank} rows without a patient, {found.odd} with a label other than 0 and 1")
    if df.groupBy(patient).agg(F.max(label).alias("y")).select("y").distinct().count() < 2:
        raise ValueError(f"{what}: both classes are needed among patients")
    return df


def require_disjoint(frames: list[DataFrame], keys: list[str]) -> None:
    """An error if any key value lies in two of the frames; one pass a key over all frames."""
    for key in keys:
        tagged = [f.select(F.col(key).alias("k"), F.lit(i).alias("frame")) for i, f in enumerate(frames) if key in f.columns]
        if len(tagged) > 1:
            rows = tagged[0]
            for more in tagged[1:]:
                rows = rows.unionByName(more)
            shared = rows.filter("k IS NOT NULL").groupBy("k").agg(F.countDistinct("frame").alias("n")).filter("n > 1").limit(5).collect()
            if shared:
                raise ValueError(f"{key} in several splits: {[r.k for r in shared]}")


def require_ready(blockers: list[str]) -> None:
    """The training gate."""
    if blockers:
        raise ValueError(f"not ready for training: {', '.join(blockers)}")
