"""Problem 1: splits that keep the slides and tiles of tied patients together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.identifiers import folder_of, tidy_path, tidy_upper
from tessella.llm.components import connected_components, group_pairs, proportional_splits
from tessella.plans.registry import Registry
from tessella.session import cut_lineage, read

REGISTRY = Registry()
query = REGISTRY.query

#: Proportions of the splits, as in step 4 of the pipeline.
SHARES = {"train": 0.7, "val": 0.15, "test": 0.15}


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide, patient), distinct; slides without a patient are left out."""
    rows = read(spark, sf_dir, "slide_patient_map").select(tidy_upper("slide_id").alias("slide"), tidy_upper("patient_id").alias("patient"))
    return rows.filter("slide IS NOT NULL AND patient IS NOT NULL").distinct()


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide, folder), distinct: slides with a tile in another slide's folder."""
    tiles = read(spark, sf_dir, "tissue_detection").select(tidy_upper("slide_id").alias("slide"), F.upper(folder_of(tidy_path("tile_path"))).alias("folder"))
    return tiles.filter("slide <> folder").distinct()


def patient_ties(owners: DataFrame, filed: DataFrame) -> DataFrame:
    """(a, b): patient ties, at most one for each owner and each misfiled slide.

    A slide stands for its smallest patient; its others are tied to that one. This
    contracts the graph of patients and slides to patients before any round runs.
    """
    first = owners.groupBy("slide").agg(F.min("patient").alias("head"), F.max("patient").alias("last"))
    shared = owners.join(first.filter("head <> last").select("slide", "head"), "slide").filter("patient <> head").select(F.col("head").alias("a"), F.col("patient").alias("b"))
    heads = first.select("slide", "head")
    across = filed.join(heads, "slide").select("folder", F.col("head").alias("a")).join(heads.select(F.col("slide").alias("folder"), F.col("head").alias("b")), "folder").select("a", "b")
    return shared.unionByName(across.filter("a <> b"))


@query("p1_found", sql=r"""
WITH RECURSIVE owners AS (SELECT DISTINCT upper(trim(slide_id)) s, upper(trim(patient_id)) p FROM slide_patient_map WHERE trim(slide_id) <> '' AND trim(patient_id) <> ''),
filed AS (SELECT DISTINCT upper(trim(slide_id)) s, upper(split_part(trim(regexp_replace(regexp_replace(replace(trim(tile_path), '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '/'), '/', 1)) f FROM tissue_detection WHERE trim(slide_id) <> ''),
ties AS (SELECT a.p a, b.p b FROM owners a JOIN owners b USING (s) WHERE a.p <> b.p
  UNION SELECT a.p, b.p FROM filed JOIN owners a ON a.s = filed.s JOIN owners b ON b.s = filed.f WHERE a.p <> b.p),
sym AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT DISTINCT a AS patient_a, b AS patient_b FROM reach WHERE a < b""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of patients that must share a split."""
    ties = patient_ties(_owners(spark, sf_dir), _filed(spark, sf_dir))
    pairs = group_pairs(connected_components(ties, "a", "b"), "node", "component")
    return pairs.select(F.col("a").alias("patient_a"), F.col("b").alias("patient_b"))


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_kind, record_no, component) of every row of both tables.

    Besides patients, slides that nobody owns are nodes here, so that a tile, its slide
    and its folder never part. A row that refers to nothing is a component of its own.
    """
    owners, filed = _owners(spark, sf_dir), _filed(spark, sf_dir)
    heads = owners.groupBy("slide").agg(F.concat(F.lit("P:"), F.min("patient")).alias("head"))
    shared = owners.join(heads, "slide").select(F.col("head").alias("a"), F.concat(F.lit("P:"), "patient").alias("b"))
    side = filed.join(heads, "slide", "left").select("folder", F.coalesce("head", F.concat(F.lit("S:"), "slide")).alias("a"))
    side = side.join(heads.select(F.col("slide").alias("folder"), F.col("head").alias("other")), "folder", "left")
    edges = shared.unionByName(side.select("a", F.coalesce("other", F.concat(F.lit("S:"), "folder")).alias("b")))
    components = connected_components(edges.filter("a <> b").distinct(), "a", "b")
    slides = read(spark, sf_dir, "slide_patient_map").select(F.lit("slide").alias("record_kind"), F.col("row_no").alias("record_no"), tidy_upper("slide_id").alias("slide"), tidy_upper("patient_id").alias("patient"))
    tiles = read(spark, sf_dir, "tissue_detection").select(F.lit("tile").alias("record_kind"), F.col("tile_no").alias("record_no"), F.coalesce(tidy_upper("slide_id"), F.upper(folder_of(tidy_path("tile_path")))).alias("slide"), F.lit(None).cast("string").alias("patient"))
    rows = slides.unionByName(tiles).join(heads, "slide", "left")
    alone = F.concat_ws(":", F.lit("R"), "record_kind", F.col("record_no").cast("string"))
    rows = rows.select("record_kind", "record_no", F.coalesce("head", F.concat(F.lit("S:"), "slide"), F.concat(F.lit("P:"), "patient"), alone).alias("node"))
    return rows.join(components, "node", "left").select("record_kind", "record_no", F.coalesce("component", "node").alias("component"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, record_kind, record_no, split) of every row of both tables."""
    return proportional_splits(cut_lineage(tied(spark, sf_dir)), "component", "record_kind", ["slide", "tile"], SHARES)


_SLIDE = "nullif(upper(trim(slide_id)), '')"
_FOLDER = r"nullif(upper(split_part(trim(regexp_replace(regexp_replace(replace(trim(tile_path), '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '/'), '/', 1)), '')"


@query("p1_components", sql=f"""
WITH RECURSIVE owners AS (SELECT DISTINCT {_SLIDE} s, nullif(upper(trim(patient_id)), '') p FROM slide_patient_map WHERE trim(slide_id) <> '' AND trim(patient_id) <> ''),
heads AS (SELECT s, 'P:' || min(p) AS head FROM owners GROUP BY s),
filed AS (SELECT DISTINCT {_SLIDE} s, {_FOLDER} f FROM tissue_detection WHERE {_SLIDE} <> {_FOLDER}),
edges AS (SELECT head AS a, 'P:' || p AS b FROM owners JOIN heads USING (s)
  UNION SELECT coalesce(h.head, 'S:' || filed.s), coalesce(g.head, 'S:' || filed.f) FROM filed LEFT JOIN heads h ON h.s = filed.s LEFT JOIN heads g ON g.s = filed.f),
sym AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
comp AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a),
r AS (SELECT 'slide' AS record_kind, row_no AS record_no, {_SLIDE} AS slide, nullif(upper(trim(patient_id)), '') AS patient FROM slide_patient_map
  UNION ALL SELECT 'tile', tile_no, coalesce({_SLIDE}, {_FOLDER}), NULL FROM tissue_detection),
n AS (SELECT record_kind, record_no, coalesce(head, 'S:' || slide, 'P:' || patient, 'R:' || record_kind || ':' || record_no) AS node FROM r LEFT JOIN heads ON heads.s = r.slide)
SELECT record_kind, record_no, coalesce(component, node) AS component FROM n LEFT JOIN comp USING (node)""")
def p1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every slide and tile; what has the same must not be parted."""
    return tied(spark, sf_dir)


@query("p1_splits")
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every slide and tile."""
    return assigned(spark, sf_dir).select("record_kind", "record_no", "component", "split")


@query("p1_report")
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, components and shares reached by each split, against the shares asked for."""
    counts = assigned(spark, sf_dir).groupBy("record_kind", "split").agg(F.count("*").alias("n_rows"), F.countDistinct("component").alias("n_components"))
    totals = counts.groupBy("record_kind").agg(F.sum("n_rows").alias("n_total"))
    target = F.create_map(*[F.lit(x) for pair in SHARES.items() for x in pair])
    return counts.join(totals, "record_kind").select("record_kind", "split", "n_rows", "n_components", F.round(F.col("n_rows") / F.col("n_total"), 6).alias("share"), target[F.col("split")].alias("target_share"))
