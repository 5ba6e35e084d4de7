"""Queries of the cohort overview and quality reports: counts, rates, summaries, row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.identifiers import tidy_lower, tidy_upper
from tessella.operators.packing import exact_medians
from tessella.plans.registry import Registry
from tessella.session import read

REGISTRY = Registry()
query = REGISTRY.query

_LENS = r"(CASE WHEN regexp_full_match(l, '\d+') THEN l || 'X' ELSE l END)"
#: Quality rows with parsed lens text and strict grade, as SQL.
QC = rf"""(SELECT row_no, image_id, data_provider, tissue_ratio, blur, pass_qc, error, ingested_at, {_LENS} AS lens, grade FROM
(SELECT *, regexp_replace(replace(upper(trim(coalesce(objective_lens, ''))), ' ', ''), '\.0$', '') AS l, try_cast(regexp_extract(trim(isup_grade), '^((ISUP|Grade|Glade)\s*[:=]?\s*)?([0-5])(\.0)?$', 3, 'i') AS INT) AS grade FROM qc_objective_lens))"""

#: Thresholds of tissue and blur by lens; a row must exceed both (fixed values).
QC_THRESHOLDS = {"4X": (0.03, 25.0), "10X": (0.05, 40.0), "40X": (0.05, 20.0)}
QC_DEFAULT = (0.05, 35.0)


def qc(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "qc_objective_lens")
    return rows.select("row_no", "image_id", "data_provider", "tissue_ratio", "blur", "pass_qc", "error", "ingested_at", X.lens_text(F.col("objective_lens")).alias("lens"), X.strict_grade(F.col("isup_grade")).alias("grade"))


def passes(tissue: str, blur: str, lens: str):
    """Whether a row passes the thresholds of its lens; null readings do not."""
    ok = None
    for name, (t, b) in QC_THRESHOLDS.items():
        test = (F.col(tissue) > t) & (F.col(blur) > b)
        ok = F.when(F.col(lens) == name, test) if ok is None else ok.when(F.col(lens) == name, test)
    return F.coalesce(ok.otherwise((F.col(tissue) > QC_DEFAULT[0]) & (F.col(blur) > QC_DEFAULT[1])), F.lit(False))


_PASS = "coalesce(CASE lens WHEN '4X' THEN tissue_ratio > 0.03e0 AND blur > 25 WHEN '10X' THEN tissue_ratio > 0.05e0 AND blur > 40 WHEN '40X' THEN tissue_ratio > 0.05e0 AND blur > 20 ELSE tissue_ratio > 0.05e0 AND blur > 35 END, false)"


@query("scl27_pass_by_lens", f"SELECT row_no, {_PASS} AS passed FROM {QC}")
def scl27(spark, sf_dir):
    return qc(spark, sf_dir).select("row_no", passes("tissue_ratio", "blur", "lens").alias("passed"))


@query("agg01_value_counts", f"SELECT grade, count(*) AS n FROM {QC} WHERE grade IS NOT NULL GROUP BY 1 ORDER BY 1")
def agg01(spark, sf_dir):
    return qc(spark, sf_dir).filter("grade IS NOT NULL").groupBy("grade").agg(F.count("*").alias("n")).orderBy("grade")


@query("agg02_group_size", "SELECT objective_label, has_cancer, count(*) AS n FROM tissue_detection GROUP BY 1, 2")
def agg02(spark, sf_dir):
    return read(spark, sf_dir, "tissue_detection").groupBy("objective_label", "has_cancer").agg(F.count("*").alias("n"))


@query("agg03_crosstab", "SELECT grade, " + ", ".join(f"count(*) FILTER (lens = '{x}') AS lens_{x}" for x in ("4X", "10X", "20X", "40X")) + f" FROM {QC} WHERE grade IS NOT NULL GROUP BY 1")
def agg03(spark, sf_dir):
    lenses = ["4X", "10X", "20X", "40X"]
    table = qc(spark, sf_dir).filter("grade IS NOT NULL").groupBy("grade").pivot("lens", lenses).count().fillna(0)
    return table.select("grade", *[F.col(x).alias(f"lens_{x}") for x in lenses])


@query("agg04_qc_by_lens", f"""SELECT lens, count(image_id) AS total_images, count(*) FILTER (pass_qc) AS pass_qc_images, count(*) FILTER (coalesce(error, '') <> '') AS failed_or_unreadable,
round(avg(tissue_ratio), 6) AS mean_tissue_ratio, round(median(blur), 6) AS median_blur, round(avg(CAST(pass_qc AS INT)), 6) AS pass_rate, round(avg(CAST(pass_qc AS INT)) * 100, 2) AS pass_rate_pct FROM {QC} GROUP BY 1""")
def agg04(spark, sf_dir):
    rate, rows = F.avg(F.col("pass_qc").cast("int")), qc(spark, sf_dir)
    counts = rows.groupBy("lens").agg(
        F.count("image_id").alias("total_images"), F.count_if("pass_qc").alias("pass_qc_images"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed_or_unreadable"),
        F.round(F.avg("tissue_ratio"), 6).alias("mean_tissue_ratio"), F.round(rate, 6).alias("pass_rate"), F.round(rate * 100, 2).alias("pass_rate_pct"))
    medians = exact_medians(rows, "lens", "blur").select(F.col("lens").alias("of"), F.round("median", 6).alias("median_blur"))
    return counts.join(medians, F.col("lens").eqNullSafe(F.col("of")), "left").drop("of")


@query("agg05_qc_pass_by_grade", f"SELECT grade, count(image_id) AS images_after_qc FROM {QC} WHERE pass_qc AND grade IS NOT NULL GROUP BY 1")
def agg05(spark, sf_dir):
    return qc(spark, sf_dir).filter("pass_qc AND grade IS NOT NULL").groupBy("grade").agg(F.count("image_id").alias("images_after_qc"))


_MAXGRADE = "(SELECT upper(trim(m.patient_id)) AS patient_id, upper(trim(m.slide_id)) AS slide_id FROM slide_patient_map m WHERE trim(m.patient_id) <> '' AND trim(m.slide_id) <> '' GROUP BY 1, 2)"
_SPLIT = "(SELECT upper(trim(patient_id)) AS patient_id, lower(trim(split)) AS split, max_isup, patient_label FROM patient_level_split WHERE trim(patient_id) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(patient_id)) ORDER BY assigned_at DESC, row_no DESC) = 1)"


def split_rows(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "patient_level_split").select(tidy_upper("patient_id").alias("patient_id"), F.struct("assigned_at", "row_no", tidy_lower("split").alias("split"), "max_isup", "patient_label").alias("r")).filter("patient_id IS NOT NULL")
    return rows.groupBy("patient_id").agg(F.max("r").alias("r")).select("patient_id", "r.split", "r.max_isup", "r.patient_label")


def owners(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "slide_patient_map").select(tidy_upper("slide_id").alias("slide_id"), tidy_upper("patient_id").alias("patient_id")).filter("slide_id IS NOT NULL AND patient_id IS NOT NULL").distinct()


@query("agg06_split_counts", f"""SELECT split, count(*) AS n_patients, count(*) FILTER (max_isup = 0) AS n_benign, count(*) FILTER (max_isup = 3) AS n_g3, count(*) FILTER (max_isup = 4) AS n_g4, count(*) FILTER (max_isup = 5) AS n_g5, count(*) FILTER (max_isup > 0) AS n_cancer FROM {_SPLIT} GROUP BY 1""")
def agg06(spark, sf_dir):
    g = F.col("max_isup")
    return split_rows(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_patients"), *[F.count_if(c).alias(n) for n, c in (("n_benign", g == 0), ("n_g3", g == 3), ("n_g4", g == 4), ("n_g5", g == 5), ("n_cancer", g > 0))])


@query("agg07_patient_rollup", f"""SELECT s.patient_id, s.split, s.patient_label, s.max_isup, count(o.slide_id) AS n_slides FROM {_SPLIT} s LEFT JOIN {_MAXGRADE} o USING (patient_id) GROUP BY ALL""")
def agg07(spark, sf_dir):
    counts = owners(spark, sf_dir).groupBy("patient_id").agg(F.count("*").alias("n_slides"))
    return split_rows(spark, sf_dir).join(counts, "patient_id", "left").select("patient_id", "split", "patient_label", "max_isup", F.coalesce("n_slides", F.lit(0)).alias("n_slides"))


@query("join02_tiles_per_patient", f"""SELECT s.patient_id, coalesce(t.n, 0) AS n_tiles FROM {_SPLIT} s LEFT JOIN (SELECT o.patient_id, count(*) AS n FROM tissue_detection t JOIN {_MAXGRADE} o ON o.slide_id = upper(trim(t.slide_id)) GROUP BY 1) t USING (patient_id)""")
def join02(spark, sf_dir):
    tiles = read(spark, sf_dir, "tissue_detection").select(tidy_upper("slide_id").alias("slide_id")).groupBy("slide_id").agg(F.count("*").alias("n"))
    counts = tiles.join(owners(spark, sf_dir), "slide_id").groupBy("patient_id").agg(F.sum("n").alias("n"))
    return split_rows(spark, sf_dir).join(counts, "patient_id", "left").select("patient_id", F.coalesce("n", F.lit(0)).alias("n_tiles"))


_NULLS = ["byte_size", "source_signature", "patient_id", "case_label", "raw_glade"]


@query("agg08_missing_pct", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CAST({c} IS NULL AS INT)) * 100, 2) AS missing_pct FROM catalog_images" for c in _NULLS))
def agg08(spark, sf_dir):
    one = read(spark, sf_dir, "catalog_images").agg(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 2).alias(c) for c in _NULLS])
    return one.unpivot([], _NULLS, "column_name", "missing_pct")


_CASES = "(SELECT case_label, count(*) AS n FROM catalog_images WHERE case_label IS NOT NULL GROUP BY 1)"


@query("agg09_imbalance", f"SELECT round(max(n) / min(n), 6) AS imbalance FROM {_CASES}")
def agg09(spark, sf_dir):
    counts = read(spark, sf_dir, "catalog_images").filter("case_label IS NOT NULL").groupBy("case_label").count()
    return counts.agg(F.round(F.max("count") / F.min("count"), 6).alias("imbalance"))


@query("agg10_entropy", f"WITH p AS (SELECT n / sum(n) OVER () AS p FROM (SELECT grade, count(*) AS n FROM {QC} WHERE grade IS NOT NULL GROUP BY 1)) SELECT round(sum(-p * log2(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS normalized FROM p")
def agg10(spark, sf_dir):
    counts = qc(spark, sf_dir).filter("grade IS NOT NULL").groupBy("grade").agg(F.count("*").alias("n"))
    p = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).withColumn("p", F.col("n") / F.col("all"))
    h = F.sum(-F.col("p") * F.log2("p"))
    return p.agg(F.round(h, 6).alias("entropy"), F.round(F.when(F.count("*") > 1, h / F.log2(F.count("*").cast("double"))).otherwise(0.0), 6).alias("normalized"))


@query("agg11_long_summary", f"""SELECT 'images' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {QC} UNION ALL SELECT 'passing', CAST(count(*) FILTER (pass_qc) AS DOUBLE) FROM {QC} UNION ALL SELECT 'pass_rate_pct', round(avg(CAST(pass_qc AS INT)) * 100, 2) FROM {QC} UNION ALL SELECT 'with_error', CAST(count(*) FILTER (coalesce(error, '') <> '') AS DOUBLE) FROM {QC}""")
def agg11(spark, sf_dir):
    one = qc(spark, sf_dir).agg(F.count("*").cast("double").alias("images"), F.count_if("pass_qc").cast("double").alias("passing"), F.round(F.avg(F.col("pass_qc").cast("int")) * 100, 2).alias("pass_rate_pct"), F.count_if(F.coalesce("error", F.lit("")) != "").cast("double").alias("with_error"))
    return one.unpivot([], ["images", "passing", "pass_rate_pct", "with_error"], "metric", "value")


@query("agg12_split_brightness", f"""SELECT s.split, count(*) AS n, round(avg(t.tissue_ratio), 6) AS mean_tissue, round(stddev_samp(t.tissue_ratio), 6) AS std_tissue FROM tissue_detection t JOIN {_MAXGRADE} o ON o.slide_id = upper(trim(t.slide_id)) JOIN {_SPLIT} s USING (patient_id) WHERE t.tissue_ratio IS NOT NULL GROUP BY 1""")
def agg12(spark, sf_dir):
    tiles = read(spark, sf_dir, "tissue_detection").filter("tissue_ratio IS NOT NULL").select(tidy_upper("slide_id").alias("slide_id"), "tissue_ratio")
    joined = tiles.join(owners(spark, sf_dir), "slide_id").join(split_rows(spark, sf_dir).select("patient_id", "split"), "patient_id")
    return joined.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("tissue_ratio"), 6).alias("mean_tissue"), F.round(F.stddev_samp("tissue_ratio"), 6).alias("std_tissue"))


@query("agg29_match_coverage", """WITH m AS (SELECT DISTINCT upper(trim(slide_id)) AS s FROM slide_patient_map WHERE trim(slide_id) <> '') SELECT provider, count(*) AS total, count(m.s) AS matched, count(*) - count(m.s) AS excluded FROM tissue_detection t LEFT JOIN m ON m.s = upper(trim(t.slide_id)) GROUP BY 1""")
def agg29(spark, sf_dir):
    known = read(spark, sf_dir, "slide_patient_map").select(tidy_upper("slide_id").alias("s")).filter("s IS NOT NULL").distinct()
    tiles = read(spark, sf_dir, "tissue_detection").select("provider", tidy_upper("slide_id").alias("t"))
    return tiles.join(known, F.col("t") == F.col("s"), "left").groupBy("provider").agg(F.count("*").alias("total"), F.count("s").alias("matched"), (F.count("*") - F.count("s")).alias("excluded"))


@query("agg33_histogram", f"""WITH b AS (SELECT min(blur) AS lo, max(blur) AS hi FROM {QC} WHERE NOT isnan(blur)) SELECT least(CAST(floor((blur - lo) / (hi - lo) * 30) AS INT), 29) AS bin, count(*) AS n FROM {QC}, b WHERE blur IS NOT NULL AND NOT isnan(blur) GROUP BY 1""")
def agg33(spark, sf_dir):
    rows = qc(spark, sf_dir).filter("blur IS NOT NULL AND NOT isnan(blur)").select("blur")
    ends = rows.agg(F.min("blur").alias("lo"), F.max("blur").alias("hi"))
    place = F.least(F.floor((F.col("blur") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30).cast("int"), F.lit(29))
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


@query("agg34_image_sizes", "SELECT width, height, count(*) AS n FROM processing WHERE decode_ok GROUP BY 1, 2")
def agg34(spark, sf_dir):
    return read(spark, sf_dir, "processing").filter("decode_ok").groupBy("width", "height").agg(F.count("*").alias("n"))


@query("agg35_tiles_per_slide", """WITH q AS (SELECT DISTINCT upper(trim(image_id)) AS s FROM qc_objective_lens WHERE trim(image_id) <> ''), n AS (SELECT q.s, count(t.tile_no) AS n FROM q LEFT JOIN tissue_detection t ON upper(trim(t.slide_id)) = q.s GROUP BY 1) SELECT round(avg(n), 6) AS mean_tiles, median(n) AS median_tiles, count(*) FILTER (n = 0) AS without_tiles FROM n""")
def agg35(spark, sf_dir):
    slides = read(spark, sf_dir, "qc_objective_lens").select(tidy_upper("image_id").alias("s")).filter("s IS NOT NULL").distinct()
    tiles = read(spark, sf_dir, "tissue_detection").select(tidy_upper("slide_id").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    counts = slides.join(tiles, "s", "left").fillna(0, ["n"])
    return counts.agg(F.round(F.avg("n"), 6).alias("mean_tiles"), F.median("n").alias("median_tiles"), F.count_if(F.col("n") == 0).alias("without_tiles"))


@query("agg37_daily_usage", """WITH i AS (SELECT user_id, ts AS a, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS b FROM events WHERE value > 0),
d AS (SELECT *, unnest(range(date_trunc('day', a + INTERVAL 7 HOUR), b + INTERVAL 7 HOUR, INTERVAL 1 DAY)) AS day FROM i)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(sum((epoch_us(least(b + INTERVAL 7 HOUR, day + INTERVAL 1 DAY)) - epoch_us(greatest(a + INTERVAL 7 HOUR, day))) / 1000000.0e0), 3) AS seconds FROM d GROUP BY 1, 2""")
def agg37(spark, sf_dir):
    """Used seconds a local day (UTC+7), intervals being cut at local midnight."""
    rows = read(spark, sf_dir, "events").filter("value > 0").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) + 7 * 3_600_000_000).alias("a"), F.round(F.col("value") * 60_000_000).cast("long").alias("len"))
    rows = rows.withColumn("b", F.col("a") + F.col("len"))
    day = 86_400_000_000
    cut = rows.withColumn("d", F.explode(F.sequence(F.floor(F.col("a") / day), F.floor((F.col("b") - 1) / day))))
    part = F.least("b", (F.col("d") + 1) * day) - F.greatest("a", F.col("d") * day)
    return cut.groupBy("user_id", F.date_format(F.date_from_unix_date(F.col("d").cast("int")), "yyyy-MM-dd").alias("day")).agg(F.round(F.sum(part / 1_000_000.0), 3).alias("seconds"))


@query("flt01_blank_ids", "SELECT count(*) AS n_kept FROM qc_objective_lens WHERE trim(image_id) <> ''")
def flt01(spark, sf_dir):
    return read(spark, sf_dir, "qc_objective_lens").filter(tidy_upper("image_id").isNotNull()).agg(F.count("*").alias("n_kept"))


@query("flt02_passing_rows", f"SELECT row_no, lens FROM {QC} WHERE pass_qc")
def flt02(spark, sf_dir):
    return qc(spark, sf_dir).filter("pass_qc").select("row_no", "lens")


_FOUND = "(SELECT DISTINCT upper(trim(image_id)) AS i FROM processing WHERE trim(image_id) <> '')"


def _processed(spark, sf_dir):
    return read(spark, sf_dir, "processing").select(tidy_upper("image_id").alias("i")).filter("i IS NOT NULL").distinct()


@query("flt03_problem_rows", f"SELECT q.row_no, q.grade IS NULL AS no_grade, f.i IS NULL AS no_image FROM {QC} q LEFT JOIN {_FOUND} f ON f.i = upper(trim(q.image_id)) WHERE q.grade IS NULL OR f.i IS NULL")
def flt03(spark, sf_dir):
    rows = qc(spark, sf_dir).withColumn("k", tidy_upper("image_id")).join(_processed(spark, sf_dir), F.col("k") == F.col("i"), "left")
    return rows.filter("grade IS NULL OR i IS NULL").select("row_no", F.col("grade").isNull().alias("no_grade"), F.col("i").isNull().alias("no_image"))


@query("join01_qc_metadata", f"""WITH c AS (SELECT upper(trim(image_id)) AS i, max(case_label) AS label FROM catalog_images WHERE trim(image_id) <> '' GROUP BY 1) SELECT q.row_no, c.label, coalesce(c.label, CAST(q.grade > 0 AS INT)) AS used_label FROM {QC} q LEFT JOIN c ON c.i = upper(trim(q.image_id))""")
def join01(spark, sf_dir):
    meta = read(spark, sf_dir, "catalog_images").select(tidy_upper("image_id").alias("i"), "case_label").filter("i IS NOT NULL").groupBy("i").agg(F.max("case_label").alias("label"))
    rows = qc(spark, sf_dir).withColumn("k", tidy_upper("image_id")).join(meta, F.col("k") == F.col("i"), "left")
    return rows.select("row_no", "label", F.coalesce("label", (F.col("grade") > 0).cast("int")).alias("used_label"))


@query("join03_slide_owner", f"SELECT t.tile_no, o.patient_id FROM tissue_detection t LEFT JOIN (SELECT slide_id, min(patient_id) AS patient_id FROM {_MAXGRADE} GROUP BY 1) o ON o.slide_id = upper(trim(t.slide_id))")
def join03(spark, sf_dir):
    """Tiles with their patient; a slide with several owners takes the first, so no tile is doubled."""
    one = owners(spark, sf_dir).groupBy("slide_id").agg(F.min("patient_id").alias("patient_id"))
    return read(spark, sf_dir, "tissue_detection").select("tile_no", tidy_upper("slide_id").alias("slide_id")).join(one, "slide_id", "left").select("tile_no", "patient_id")


@query("join06_image_found", f"SELECT q.row_no, f.i IS NOT NULL AS image_found FROM {QC} q LEFT JOIN {_FOUND} f ON f.i = upper(trim(q.image_id))")
def join06(spark, sf_dir):
    rows = qc(spark, sf_dir).withColumn("k", tidy_upper("image_id")).join(_processed(spark, sf_dir), F.col("k") == F.col("i"), "left")
    return rows.select("row_no", F.col("i").isNotNull().alias("image_found"))


_CAT = "(SELECT DISTINCT upper(trim(image_id)) AS i FROM catalog_images WHERE trim(image_id) <> '')"
_QCI = "(SELECT DISTINCT upper(trim(image_id)) AS i FROM qc_objective_lens WHERE trim(image_id) <> '')"


def _ids(spark, sf_dir, table):
    return read(spark, sf_dir, table).select(tidy_upper("image_id").alias("image_id")).filter("image_id IS NOT NULL").distinct()


@query("join09_full_coverage", f"SELECT coalesce(a.i, b.i) AS image_id, CASE WHEN b.i IS NULL THEN 'catalog_only' WHEN a.i IS NULL THEN 'qc_only' ELSE 'both' END AS state FROM {_CAT} a FULL JOIN {_QCI} b ON a.i = b.i")
def join09(spark, sf_dir):
    a = _ids(spark, sf_dir, "catalog_images").withColumn("a", F.lit(True))
    b = _ids(spark, sf_dir, "qc_objective_lens").withColumn("b", F.lit(True))
    state = F.when(F.col("b").isNull(), "catalog_only").when(F.col("a").isNull(), "qc_only").otherwise("both")
    return a.join(b, "image_id", "full").select("image_id", state.alias("state"))


@query("join10_path_component", """WITH s AS (SELECT DISTINCT upper(trim(slide_id)) AS s FROM slide_patient_map WHERE trim(slide_id) <> ''),
p AS (SELECT tile_no, upper(unnest(string_split(regexp_replace(trim(tile_path), '[/\\\\]+', '/', 'g'), '/'))) AS part FROM tissue_detection)
SELECT tile_no, min(s) AS slide_id FROM p JOIN s ON s.s = p.part GROUP BY 1 HAVING count(DISTINCT s) = 1""".replace("\\\\\\\\", "\\\\"))
def join10(spark, sf_dir):
    """The one slide that a path names by a component."""
    slides = read(spark, sf_dir, "slide_patient_map").select(tidy_upper("slide_id").alias("slide_id")).filter("slide_id IS NOT NULL").distinct()
    parts = read(spark, sf_dir, "tissue_detection").select("tile_no", F.explode(F.split(F.regexp_replace(F.trim("tile_path"), r"[/\\]+", "/"), "/")).alias("part"))
    met = parts.withColumn("slide_id", F.upper("part")).join(slides, "slide_id")
    return met.groupBy("tile_no").agg(F.min("slide_id").alias("slide_id"), F.countDistinct("slide_id").alias("n")).filter("n = 1").drop("n")


@query("srt01_ordered_ids", f"SELECT i AS image_id FROM {_CAT} ORDER BY 1")
def srt01(spark, sf_dir):
    return _ids(spark, sf_dir, "catalog_images").orderBy("image_id")


@query("srt04_first_rows", "SELECT row_no, image_id FROM qc_objective_lens ORDER BY row_no LIMIT 20")
def srt04(spark, sf_dir):
    """The first rows in arrival order, the limit of a smoke run."""
    return read(spark, sf_dir, "qc_objective_lens").select("row_no", "image_id").orderBy("row_no").limit(20)


@query("srt07_seeded_sample", "SELECT tile_no FROM tissue_detection ORDER BY md5('42|' || tile_no), tile_no LIMIT 100")
def srt07(spark, sf_dir):
    """A sample of 100 tiles by hash order, the same for any partitioning."""
    key = F.md5(F.concat(F.lit("42|"), F.col("tile_no").cast("string")))
    return read(spark, sf_dir, "tissue_detection").select("tile_no", key.alias("k")).orderBy("k", "tile_no").limit(100).select("tile_no")


@query("snk12_preview_tiles", "SELECT objective_label, tile_no FROM tissue_detection QUALIFY row_number() OVER (PARTITION BY objective_label ORDER BY md5('42|' || tile_no), tile_no) <= 9")
def snk12(spark, sf_dir):
    """Nine tiles of each lens for a preview grid."""
    from pyspark.sql import Window as W

    key = F.md5(F.concat(F.lit("42|"), F.col("tile_no").cast("string")))
    place = F.row_number().over(W.partitionBy("objective_label").orderBy(key, "tile_no"))
    return read(spark, sf_dir, "tissue_detection").select("objective_label", "tile_no", place.alias("place")).filter("place <= 9").drop("place")


@query("set01_union_all", "SELECT 'catalog' AS origin, count(*) AS n FROM catalog_images UNION ALL SELECT 'qc', count(*) FROM qc_objective_lens UNION ALL SELECT 'processing', count(*) FROM processing")
def set01(spark, sf_dir):
    rows = [read(spark, sf_dir, t).select(F.lit(n).alias("origin")) for n, t in (("catalog", "catalog_images"), ("qc", "qc_objective_lens"), ("processing", "processing"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("origin").agg(F.count("*").alias("n"))


@query("set02_distinct", "SELECT DISTINCT upper(trim(patient_id)) AS patient_id, label FROM slide_patient_map WHERE trim(patient_id) <> ''")
def set02(spark, sf_dir):
    return read(spark, sf_dir, "slide_patient_map").select(tidy_upper("patient_id").alias("patient_id"), "label").filter("patient_id IS NOT NULL").distinct()


@query("set03_intersect", f"SELECT i AS image_id FROM {_CAT} INTERSECT SELECT i FROM {_QCI}")
def set03(spark, sf_dir):
    return _ids(spark, sf_dir, "catalog_images").intersect(_ids(spark, sf_dir, "qc_objective_lens"))


@query("set04_except", f"SELECT i AS image_id FROM {_CAT} EXCEPT SELECT i FROM {_QCI}")
def set04(spark, sf_dir):
    return _ids(spark, sf_dir, "catalog_images").subtract(_ids(spark, sf_dir, "qc_objective_lens"))
