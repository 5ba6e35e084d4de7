"""Queries on predictions: pooling, metrics, thresholds, splits and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.identifiers import tidy_lower, tidy_upper
from tessella.operators import metrics as M
from tessella.operators import splitting as S
from tessella.operators.training import Fit, train_head
from tessella.plans.registry import Registry
from tessella.session import read, scratch_folder

REGISTRY = Registry()
query = REGISTRY.query

#: Predictions that count, as SQL.
PRED = """(SELECT upper(trim(patient_id)) AS patient_id, slide_id, tile_path, magnification, model_name, fold, patient_label, y_prob, pred_no
FROM patient_level_cv WHERE trim(patient_id) <> '' AND patient_label IS NOT NULL AND y_prob IS NOT NULL AND NOT isnan(y_prob) AND y_prob BETWEEN 0 AND 1)"""
#: Patients per magnification with their label over all magnifications, as SQL.
PATIENTS = f"""(SELECT p.magnification, p.patient_id, l.y_true, round(avg(p.y_prob), 9) AS y_prob, count(*) AS n_tiles FROM {PRED} p
JOIN (SELECT patient_id, max(patient_label) AS y_true FROM {PRED} GROUP BY 1) l USING (patient_id) GROUP BY 1, 2, 3)"""
#: Labels per patient, as SQL.
LABELS = f"(SELECT patient_id, max(patient_label) AS label FROM {PRED} GROUP BY 1)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a patient, a label and a score in [0, 1]."""
    rows = read(spark, sf_dir, "patient_level_cv").filter("patient_label IS NOT NULL AND y_prob >= 0 AND y_prob <= 1")
    rows = rows.withColumn("patient_id", tidy_upper("patient_id")).filter("patient_id IS NOT NULL")
    return rows.select("patient_id", "slide_id", "tile_path", "magnification", "model_name", "fold", "patient_label", "y_prob", "pred_no")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient means per magnification; the label is taken before magnifications part."""
    rows = predictions(spark, sf_dir)
    return M.mean_pool(rows, ["magnification", "patient_id"]).join(M.patient_labels(rows), "patient_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.patient_labels(predictions(spark, sf_dir)).withColumnRenamed("y_true", "label")


@query("agg15_patient_mean", f"SELECT magnification, patient_id, y_true, y_prob, n_tiles FROM {PATIENTS}")
def agg15(spark, sf_dir):
    return patients(spark, sf_dir)


@query("agg16_topk_mean", f"""
SELECT magnification, patient_id, round(avg(y_prob), 9) AS y_prob FROM (SELECT *, row_number() OVER (PARTITION BY magnification, patient_id ORDER BY y_prob DESC) AS r FROM {PRED}) WHERE r <= 10 GROUP BY 1, 2""")
def agg16(spark, sf_dir):
    return M.top_k_pool(predictions(spark, sf_dir), ["magnification", "patient_id"], 10)


@query("agg17_softmax_attention", f"""
SELECT magnification, patient_id, round(sum(w * y_prob) / sum(w), 6) AS y_prob FROM (SELECT *, exp((y_prob - max(y_prob) OVER (PARTITION BY magnification, patient_id)) / 0.1e0) AS w FROM {PRED}) GROUP BY 1, 2""")
def agg17(spark, sf_dir):
    pooled = M.attention_pool(predictions(spark, sf_dir), ["magnification", "patient_id"], 0.1)
    return pooled.withColumn("y_prob", F.round("y_prob", 6))


_CONFUSION = """count(*) FILTER (y_prob >= 0.5e0 AND {y} = 1) AS tp, count(*) FILTER (y_prob < 0.5e0 AND {y} = 0) AS tn,
count(*) FILTER (y_prob >= 0.5e0 AND {y} = 0) AS fp, count(*) FILTER (y_prob < 0.5e0 AND {y} = 1) AS fn"""
_RATES = """SELECT *, round(2 * precision * sensitivity / greatest(1e-8, precision + sensitivity), 6) AS f1, round((sensitivity + specificity) / 2, 6) AS balanced_accuracy FROM
(SELECT *, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS sensitivity, tn / greatest(1, tn + fp) AS specificity, (tp + tn) / greatest(1, tp + tn + fp + fn) AS accuracy FROM ({}))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("f1", "balanced_accuracy")})


@query("agg18_tile_confusion", _RATES.format(f"SELECT model_name, magnification, {_CONFUSION.format(y='patient_label')} FROM {PRED} GROUP BY 1, 2"))
def agg18_tiles(spark, sf_dir):
    counts = predictions(spark, sf_dir).groupBy("model_name", "magnification").agg(*M.confusion("patient_label", F.col("y_prob") >= 0.5))
    return _rounded(M.rates(counts))


@query("agg18_patient_confusion", _RATES.format(f"SELECT magnification, {_CONFUSION.format(y='y_true')} FROM {PATIENTS} GROUP BY 1"))
def agg18_patients(spark, sf_dir):
    return _rounded(M.rates(patients(spark, sf_dir).groupBy("magnification").agg(*M.confusion("y_true", F.col("y_prob") >= 0.5))))


@query("agg19_strict_metrics", _RATES.format(f"SELECT magnification, {_CONFUSION.format(y='y_true')} FROM {PATIENTS} GROUP BY 1 HAVING count(DISTINCT y_true) = 2"))
def agg19(spark, sf_dir):
    """As the confusion, but only groups with both classes; the API raises for others."""
    counts = patients(spark, sf_dir).groupBy("magnification").agg(*M.confusion("y_true", F.col("y_prob") >= 0.5))
    return _rounded(M.rates(counts.filter("tp + fn > 0 AND tn + fp > 0")))


def _auc_sql(frame: str, by: str, label: str) -> str:
    return f"""
WITH r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y_prob) + (count(*) OVER (PARTITION BY {by}, y_prob) - 1) / 2 AS avg_rank FROM {frame}),
s AS (SELECT {by}, count(*) FILTER ({label} = 1) AS n_pos, count(*) FILTER ({label} = 0) AS n_neg, sum(avg_rank) FILTER ({label} = 1) AS rank_sum FROM r GROUP BY {by})
SELECT {by}, n_pos, n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rank_sum - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END, 6) AS auc FROM s"""


@query("agg20_patient_auc_by_lens", _auc_sql(PATIENTS, "magnification", "y_true"))
def agg20(spark, sf_dir):
    return M.auc(patients(spark, sf_dir), ["magnification"], "y_true", "y_prob").withColumn("auc", F.round("auc", 6))


@query("agg20_tile_auc_by_run", _auc_sql(PRED, "model_name, magnification, fold", "patient_label"))
def agg20_tiles(spark, sf_dir):
    return M.auc(predictions(spark, sf_dir), ["model_name", "magnification", "fold"], "patient_label", "y_prob").withColumn("auc", F.round("auc", 6))


_GRID = f"""(SELECT magnification, threshold, tp, tn, fp, fn, round(2 * p * s / greatest(1e-8, p + s), 12) AS f1 FROM (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS s FROM
(SELECT magnification, t.i * 0.01e0 AS threshold, count(*) FILTER (y_prob >= t.i * 0.01e0 AND y_true = 1) AS tp, count(*) FILTER (y_prob < t.i * 0.01e0 AND y_true = 0) AS tn,
count(*) FILTER (y_prob >= t.i * 0.01e0 AND y_true = 0) AS fp, count(*) FILTER (y_prob < t.i * 0.01e0 AND y_true = 1) AS fn FROM {PATIENTS}, range(101) t(i) GROUP BY 1, 2)))"""


@query("join14_threshold_grid", f"SELECT magnification, round(threshold, 6) AS threshold, tp, tn, fp, fn FROM {_GRID}")
def join14(spark, sf_dir):
    return M.threshold_grid(patients(spark, sf_dir), ["magnification"], "y_true", "y_prob").select("magnification", F.round("threshold", 6).alias("threshold"), "tp", "tn", "fp", "fn")


@query("agg21_threshold_search", f"SELECT magnification, round(threshold, 6) AS threshold, round(f1, 6) AS f1, tp, tn, fp, fn FROM {_GRID} QUALIFY row_number() OVER (PARTITION BY magnification ORDER BY f1 DESC, abs(threshold - 0.5e0), threshold) = 1")
def agg21(spark, sf_dir):
    best = M.best_threshold(M.threshold_grid(patients(spark, sf_dir), ["magnification"], "y_true", "y_prob"), ["magnification"], "f1")
    return best.select("magnification", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"), "tp", "tn", "fp", "fn")


@query("agg22_roc_points", f"""
WITH t AS (SELECT DISTINCT magnification, y_prob AS threshold FROM {PATIENTS} UNION SELECT DISTINCT magnification, unnest([0.0e0, 1.0e0]) FROM {PATIENTS}),
n AS (SELECT magnification, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM {PATIENTS} GROUP BY 1)
SELECT t.magnification, round(t.threshold, 6) AS threshold, round(count(*) FILTER (p.y_true = 1 AND p.y_prob >= t.threshold) / greatest(1, max(n.pos)), 6) AS tpr,
round(count(*) FILTER (p.y_true = 0 AND p.y_prob >= t.threshold) / greatest(1, max(n.neg)), 6) AS fpr FROM t JOIN {PATIENTS} p USING (magnification) JOIN n USING (magnification) GROUP BY t.magnification, t.threshold""")
def agg22(spark, sf_dir):
    points = M.roc_points(patients(spark, sf_dir), ["magnification"], "y_true", "y_prob")
    return points.select("magnification", *[F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("win12_roc_cumulative", f"""
SELECT magnification, round(y_prob, 6) AS y_prob, CAST(sum(sum(y_true)) OVER (PARTITION BY magnification ORDER BY y_prob DESC) AS BIGINT) AS cum_pos, CAST(sum(count(*)) OVER (PARTITION BY magnification ORDER BY y_prob DESC) AS BIGINT) AS cum_all FROM {PATIENTS} GROUP BY magnification, y_prob""")
def win12(spark, sf_dir):
    rows = patients(spark, sf_dir).withColumn("one", F.lit(1))
    sums = M.running_sums(rows, ["magnification"], "y_prob", ["y_true", "one"])
    totals = rows.groupBy("magnification").agg(F.sum("y_true").alias("tp"), F.count("*").alias("tn"))
    return sums.join(totals, "magnification").select("magnification", F.round("y_prob", 6).alias("y_prob"), (F.col("tp") - F.col("below_y_true")).alias("cum_pos"), (F.col("tn") - F.col("below_one")).alias("cum_all"))


@query("agg23_calibration_bins", f"""
SELECT magnification, b AS bin, round(avg(y_prob), 6) AS mean_score, round(avg(y_true), 6) AS fraction_pos, count(*) AS n FROM {PATIENTS}, range(10) t(b)
WHERE y_prob > b * 0.1e0 AND y_prob <= CASE WHEN b = 9 THEN 1e0 ELSE (b + 1) * 0.1e0 END GROUP BY 1, 2""")
def agg23(spark, sf_dir):
    bins = M.calibration_bins(patients(spark, sf_dir), ["magnification"], "y_true", "y_prob")
    return bins.select("magnification", "bin", F.round("mean_score", 6).alias("mean_score"), F.round("fraction_pos", 6).alias("fraction_pos"), "n")


#: Draws of an evaluation by default.
DRAWS = 1000
_WEIGHT = " + ".join(f"CAST(u >= {s}e0 AS INT)" for s in M.POISSON_STEPS)


@query("agg24_bootstrap_auc_ci", f"""
WITH d AS (SELECT *, CAST('0x' || md5('17|' || draw // 4 || '|' || patient_id)[1 + 8 * (draw % 4) : 8 + 8 * (draw % 4)] AS UBIGINT) / 4294967296.0e0 AS u FROM {PATIENTS}, range(1, 1001) t(draw)),
w AS (SELECT magnification, draw, y_prob, sum(CASE WHEN y_true = 1 THEN {_WEIGHT} ELSE 0 END) AS p, sum(CASE WHEN y_true = 0 THEN {_WEIGHT} ELSE 0 END) AS n FROM d GROUP BY 1, 2, 3),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY magnification, draw ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w),
a AS (SELECT magnification, draw, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM c GROUP BY 1, 2 HAVING sum(p) > 0 AND sum(n) > 0)
SELECT magnification, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high, count(*) AS draws FROM a GROUP BY 1""")
def agg24(spark, sf_dir):
    ci = M.bootstrap_auc(patients(spark, sf_dir), ["magnification"], "patient_id", "y_true", "y_prob", DRAWS, 17, by_digest=True)
    return ci.select("magnification", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "draws")


@query("agg24_patient_auc_ci")
def agg24_patients(spark, sf_dir):
    """As agg24_bootstrap_auc_ci, with faster hashes that SQL has not."""
    ci = M.bootstrap_auc(patients(spark, sf_dir), ["magnification"], "patient_id", "y_true", "y_prob", DRAWS, 17)
    return ci.select("magnification", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "draws")


@query("agg24_tile_auc_ci")
def agg24_tiles(spark, sf_dir):
    """Each prediction is resampled by itself, with its own label."""
    ci = M.bootstrap_auc(predictions(spark, sf_dir), ["model_name", "magnification"], "pred_no", "patient_label", "y_prob", DRAWS, 17)
    return ci.select("model_name", "magnification", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "draws")


#: Fold whose patients choose the threshold of a run; the others test it.
VALIDATION = 0
_POOLED = f"(SELECT model_name, magnification, fold = {VALIDATION} AS chooses, p.patient_id, l.y_true, round(avg(p.y_prob), 9) AS y_prob FROM {PRED} p JOIN (SELECT patient_id, max(patient_label) AS y_true FROM {PRED} GROUP BY 1) l USING (patient_id) WHERE fold IS NOT NULL GROUP BY ALL)"


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and magnification: the threshold with the best F1 on the validation fold, frozen with its digest, and the test folds judged by it."""
    rows = predictions(spark, sf_dir).filter("fold IS NOT NULL").withColumn("chooses", F.col("fold") == VALIDATION)
    run = ["model_name", "magnification"]
    pooled = M.mean_pool(rows, [*run, "chooses", "patient_id"]).join(M.patient_labels(predictions(spark, sf_dir)), "patient_id")
    best = M.best_threshold(M.threshold_grid(pooled.filter("chooses"), run, "y_true", "y_prob"), run, "f1")
    frozen = best.select(*run, "threshold", F.round("f1", 6).alias("validation_f1"), F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in run], F.round(F.col("threshold") * 100).cast("int").cast("string")), 256).alias("frozen_sha256"))
    test = pooled.filter("NOT chooses")
    judged = M.rates(test.join(F.broadcast(frozen), run).groupBy(*run).agg(*M.confusion("y_true", F.col("y_prob") >= F.col("threshold"))))
    auc = M.auc(test, run, "y_true", "y_prob").select(*run, F.round("auc", 6).alias("test_auc"))
    return frozen.join(judged, run).join(auc, run).select(*run, F.round("threshold", 2).alias("threshold"), "validation_f1", "frozen_sha256", "tp", "tn", "fp", "fn", F.round("sensitivity", 6).alias("test_sensitivity"), F.round("specificity", 6).alias("test_specificity"), "test_auc")


@query("ml05_run_report", f"""
WITH g AS (SELECT model_name, magnification, t.i, count(*) FILTER (y_prob >= t.i * 0.01e0 AND y_true = 1) AS tp, count(*) FILTER (y_prob >= t.i * 0.01e0 AND y_true = 0) AS fp, count(*) FILTER (y_prob < t.i * 0.01e0 AND y_true = 1) AS fn
  FROM {_POOLED}, range(101) t(i) WHERE chooses GROUP BY 1, 2, 3),
f AS (SELECT *, round(2 * p * s / greatest(1e-8, p + s), 12) AS f1 FROM (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS s FROM g)),
b AS (SELECT model_name, magnification, i, f1 FROM f QUALIFY row_number() OVER (PARTITION BY model_name, magnification ORDER BY f1 DESC, abs(i - 50), i) = 1),
t AS (SELECT * FROM {_POOLED} WHERE NOT chooses),
k AS (SELECT model_name, magnification, count(*) FILTER (y_prob >= i * 0.01e0 AND y_true = 1) AS tp, count(*) FILTER (y_prob < i * 0.01e0 AND y_true = 0) AS tn, count(*) FILTER (y_prob >= i * 0.01e0 AND y_true = 0) AS fp, count(*) FILTER (y_prob < i * 0.01e0 AND y_true = 1) AS fn
  FROM t JOIN b USING (model_name, magnification) GROUP BY 1, 2),
r AS (SELECT *, (count(*) OVER (PARTITION BY model_name, magnification ORDER BY y_prob RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + count(*) OVER (PARTITION BY model_name, magnification ORDER BY y_prob RANGE UNBOUNDED PRECEDING EXCLUDE GROUP) + 1) / 2 AS place FROM t),
a AS (SELECT model_name, magnification, round((sum(place) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2) / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0)), 6) AS test_auc FROM r GROUP BY 1, 2)
SELECT model_name, magnification, round(i * 0.01e0, 2) AS threshold, round(f1, 6) AS validation_f1, sha256(model_name || '|' || magnification || '|' || i) AS frozen_sha256, tp, tn, fp, fn,
round(tp / greatest(1, tp + fn), 6) AS test_sensitivity, round(tn / greatest(1, tn + fp), 6) AS test_specificity, test_auc FROM b JOIN k USING (model_name, magnification) JOIN a USING (model_name, magnification)""")
def ml05(spark, sf_dir):
    return run_report(spark, sf_dir)


@query("ml03_linear_head")
def ml03(spark, sf_dir):
    """Epochs of a binary head over the embeddings, trained on three quarters of made-up patients and judged by the others."""
    rows = read(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("v"), (F.col("label") % 2).alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("patient"))
    try:
        _, history = train_head(rows.filter("patient % 4 > 0"), rows.filter("patient % 4 = 0"), "v", "y", "patient", scratch_folder(spark, "head"), Fit(epochs=8))
    except ValueError:  # one class or none
        history = []
    return spark.createDataFrame(history, "epoch int, loss double, auc double, best double").select("epoch", *[F.round(c, 6).alias(c) for c in ("loss", "auc", "best")])


@query("agg30_seed_ensemble", f"""
WITH m AS (SELECT model_name, patient_id, round(avg(y_prob), 9) AS y_prob FROM {PRED} GROUP BY 1, 2)
SELECT patient_id, round(avg(y_prob), 6) AS y_prob, count(*) AS n_models FROM m GROUP BY 1""")
def agg30(spark, sf_dir):
    each = M.mean_pool(predictions(spark, sf_dir), ["model_name", "patient_id"])
    return each.groupBy("patient_id").agg(F.round(F.avg("y_prob"), 6).alias("y_prob"), F.count("*").alias("n_models"))


@query("flt21_aligned_ensemble", f"""
SELECT count(*) AS n_patients, count(*) FILTER (k < (SELECT count(DISTINCT model_name) FROM {PRED})) AS n_unaligned FROM (SELECT patient_id, count(DISTINCT model_name) AS k FROM {PRED} GROUP BY 1)""")
def flt21(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    models = rows.agg(F.countDistinct("model_name").alias("n"))
    each = rows.groupBy("patient_id").agg(F.countDistinct("model_name").alias("k"))
    return each.crossJoin(F.broadcast(models)).agg(F.count("*").alias("n_patients"), F.count_if(F.col("k") < F.col("n")).alias("n_unaligned"))


_RUNS = f"(SELECT model_name, magnification, fold, avg(y_prob) AS m, avg(CAST((y_prob >= 0.5e0) = (patient_label = 1) AS INT)) AS acc FROM {PRED} GROUP BY 1, 2, 3)"


def runs(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("model_name", "magnification", "fold").agg(F.avg("y_prob").alias("m"), F.avg(((F.col("y_prob") >= 0.5) == (F.col("patient_label") == 1)).cast("int")).alias("acc"))


@query("agg13_rollup_mean_std", f"""
SELECT model_name, magnification, count(*) AS n_runs, round(avg(acc), 6) AS acc_mean, round(coalesce(stddev_samp(acc), 0), 6) AS acc_std FROM {_RUNS} GROUP BY GROUPING SETS ((model_name, magnification), (model_name), (magnification))""")
def agg13(spark, sf_dir):
    runs(spark, sf_dir).createOrReplaceTempView("tessella_runs")
    return spark.sql("SELECT model_name, magnification, count(*) AS n_runs, round(avg(acc), 6) AS acc_mean, round(coalesce(stddev_samp(acc), 0), 6) AS acc_std FROM tessella_runs GROUP BY GROUPING SETS ((model_name, magnification), (model_name), (magnification))")


@query("agg14_metric_mean_std", f"""
SELECT model_name, 'acc' AS metric, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS std FROM {_RUNS} GROUP BY 1 UNION ALL SELECT model_name, 'm', round(avg(m), 6), round(stddev_samp(m), 6) FROM {_RUNS} GROUP BY 1""")
def agg14(spark, sf_dir):
    long = runs(spark, sf_dir).select("model_name", F.expr("stack(2, 'acc', acc, 'm', m) AS (metric, v)"))
    return long.groupBy("model_name", "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"))


@query("scl30_mean_std_text", f"SELECT model_name, printf('%.4f ± %.4f', avg(acc), coalesce(stddev_samp(acc), 0)) AS summary FROM {_RUNS} GROUP BY 1")
def scl30(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("model_name").agg(F.format_string("%.4f ± %.4f", F.avg("acc"), F.coalesce(F.stddev_samp("acc"), F.lit(0.0))).alias("summary"))


@query("srt03_model_rank", f"SELECT model_name, magnification, fold, CASE model_name WHEN 'effnet_b0' THEN 0 WHEN 'convnext' THEN 1 WHEN 'vit_tiny' THEN 2 ELSE 99 END AS model_rank FROM {_RUNS} ORDER BY model_rank, model_name, magnification, fold")
def srt03(spark, sf_dir):
    rank = F.when(F.col("model_name") == "effnet_b0", 0).when(F.col("model_name") == "convnext", 1).when(F.col("model_name") == "vit_tiny", 2).otherwise(99)
    return runs(spark, sf_dir).select("model_name", "magnification", "fold", rank.alias("model_rank")).orderBy("model_rank", "model_name", "magnification", "fold")


@query("srt02_runs_by_metric", f"SELECT model_name, magnification, fold, round(acc, 6) AS acc FROM {_RUNS} ORDER BY acc DESC, model_name, magnification, fold")
def srt02(spark, sf_dir):
    return runs(spark, sf_dir).select("model_name", "magnification", "fold", F.round("acc", 6).alias("acc")).orderBy(F.desc("acc"), "model_name", "magnification", "fold")


@query("srt05_top_runs", f"SELECT model_name, magnification, fold, round(acc, 6) AS acc FROM {_RUNS} ORDER BY round(acc, 6) DESC, model_name, magnification, fold LIMIT 10")
def srt05(spark, sf_dir):
    return srt02(spark, sf_dir).limit(10)


@query("flt05_run_selection", f"SELECT model_name, magnification, count(*) AS n FROM {PRED} WHERE model_name IN ('resnet18', 'vit_tiny') AND magnification IN (10, 40) AND fold IN (0, 1) GROUP BY 1, 2")
def flt05(spark, sf_dir):
    chosen = predictions(spark, sf_dir).filter(F.col("model_name").isin("resnet18", "vit_tiny") & F.col("magnification").isin(10, 40) & F.col("fold").isin(0, 1))
    return chosen.groupBy("model_name", "magnification").agg(F.count("*").alias("n"))


@query("flt06_magnification", f"SELECT model_name, count(*) AS n, round(avg(y_prob), 6) AS mean_score FROM {PRED} WHERE magnification = 10 GROUP BY 1")
def flt06(spark, sf_dir):
    return predictions(spark, sf_dir).filter("magnification = 10").groupBy("model_name").agg(F.count("*").alias("n"), F.round(F.avg("y_prob"), 6).alias("mean_score"))


@query("join13_run_grid", f"""
SELECT m.model_name, g.magnification, s.fold, coalesce(r.n, 0) AS n FROM (SELECT DISTINCT model_name FROM {PRED}) m, (SELECT DISTINCT magnification FROM {PRED}) g, range(5) s(fold)
LEFT JOIN (SELECT model_name, magnification, fold, count(*) AS n FROM {PRED} GROUP BY 1, 2, 3) r ON r.model_name = m.model_name AND r.magnification = g.magnification AND r.fold = s.fold""")
def join13(spark, sf_dir):
    """The grid of runs, which has models x magnifications x folds rows, and the rows of each."""
    done = predictions(spark, sf_dir).groupBy("model_name", "magnification", "fold").agg(F.count("*").alias("n"))
    grid = done.select("model_name").distinct().crossJoin(done.select("magnification").distinct()).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return grid.join(done, ["model_name", "magnification", "fold"], "left").fillna(0, ["n"])


@query("win01_average_rank", f"SELECT magnification, patient_id, rank() OVER (PARTITION BY magnification ORDER BY y_prob) + (count(*) OVER (PARTITION BY magnification, y_prob) - 1) / 2 AS avg_rank FROM {PATIENTS}")
def win01(spark, sf_dir):
    """Average ranks with ties, from running sums per score instead of one window per magnification."""
    rows = patients(spark, sf_dir).withColumn("one", F.lit(1))
    sums = M.running_sums(rows, ["magnification"], "y_prob", ["one"]).select("magnification", "y_prob", (F.col("below_one") + (F.col("one") + 1) / 2).alias("avg_rank"))
    return rows.join(sums, ["magnification", "y_prob"]).select("magnification", "patient_id", "avg_rank")


@query("win02_patient_label", f"SELECT pred_no, max(patient_label) OVER (PARTITION BY patient_id) AS patient_max_label FROM {PRED}")
def win02(spark, sf_dir):
    """The patient's greatest label on each row; joined rather than windowed, since a patient may be huge."""
    rows = predictions(spark, sf_dir)
    return rows.select("patient_id", "pred_no").join(M.patient_labels(rows), "patient_id").select("pred_no", F.col("y_true").alias("patient_max_label"))


@query("win04_patient_holdout", f"""
SELECT patient_id, label, r <= least(n - 1, greatest(1, round_even(n * 0.2e0, 0))) AS held FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || patient_id), patient_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM {LABELS})""")
def win04(spark, sf_dir):
    return S.holdout(labels(spark, sf_dir), "patient_id", "label", 0.2, 7)


@query("win05_kfold_assignment", f"SELECT patient_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('11|' || patient_id), patient_id) - 1) % 5 AS fold FROM {LABELS}")
def win05(spark, sf_dir):
    return S.folds(labels(spark, sf_dir), "patient_id", "label", 5, 11)


@query("win06_inner_split", f"""
WITH f AS (SELECT patient_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('11|' || patient_id), patient_id) - 1) % 5 AS fold FROM {LABELS}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('12|' || patient_id), patient_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM f WHERE fold <> 0)
SELECT patient_id, label, CASE WHEN r <= least(n - 1, greatest(1, round_even(n * 0.15e0, 0))) THEN 'val' ELSE 'train' END AS part FROM r""")
def win06(spark, sf_dir):
    """Train and validation patients inside outer fold 0; every class is in both by construction."""
    outer = S.folds(labels(spark, sf_dir), "patient_id", "label", 5, 11).filter("fold <> 0")
    return S.holdout(outer, "patient_id", "label", 0.15, 12).select("patient_id", "label", F.when(F.col("held"), "val").otherwise("train").alias("part"))


@query("win13_first_per_key", f"SELECT tile_path, pred_no, model_name FROM {PRED} QUALIFY row_number() OVER (PARTITION BY tile_path ORDER BY pred_no) = 1")
def win13(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("tile_path").agg(F.min("pred_no").alias("pred_no"), F.min_by("model_name", "pred_no").alias("model_name"))


@query("win11_early_stopping", """
WITH h AS (SELECT user_id, list(value ORDER BY ts, event_id) AS vs FROM events WHERE value IS NOT NULL GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_prepend({'best': -1e300::DOUBLE, 'at': 0, 'i': 0, 'bad': 0, 'stop': 0, 'v': 0.0::DOUBLE}, list_transform(vs, lambda v: {'best': 0.0::DOUBLE, 'at': 0, 'i': 0, 'bad': 0, 'stop': 0, 'v': v::DOUBLE})),
 lambda s, x: CASE WHEN s.stop > 0 THEN s WHEN x.v > s.best + 0.001e0 THEN {'best': x.v, 'at': s.i + 1, 'i': s.i + 1, 'bad': 0, 'stop': 0, 'v': x.v}
 ELSE {'best': s.best, 'at': s.at, 'i': s.i + 1, 'bad': s.bad + 1, 'stop': CASE WHEN s.bad + 1 >= 3 THEN s.i + 1 ELSE 0 END, 'v': x.v} END) AS s FROM h)
SELECT user_id, s.at AS best_epoch, round(s.best, 6) AS best_value, s.stop AS stop_epoch FROM f""")
def win11(spark, sf_dir):
    """Best epoch and stop of each history, an ordered fold because of the least improvement.

    A history is one run's epochs (here one user's events), short by nature.
    """
    rows = read(spark, sf_dir, "events").filter("value IS NOT NULL").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("h"))
    zero = F.struct(F.lit(-1e300).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(0).alias("bad"), F.lit(0).alias("stop"))

    def step(s, x):
        better = F.struct(x["value"].alias("best"), (s["i"] + 1).alias("at"), (s["i"] + 1).alias("i"), F.lit(0).alias("bad"), F.lit(0).alias("stop"))
        worse = F.struct(s["best"].alias("best"), s["at"].alias("at"), (s["i"] + 1).alias("i"), (s["bad"] + 1).alias("bad"), F.when(s["bad"] + 1 >= 3, s["i"] + 1).otherwise(0).alias("stop"))
        return F.when(s["stop"] > 0, s).when(x["value"] > s["best"] + 0.001, better).otherwise(worse)

    folded = rows.select("user_id", F.aggregate("h", zero, step).alias("s"))
    return folded.select("user_id", F.col("s.at").alias("best_epoch"), F.round("s.best", 6).alias("best_value"), F.col("s.stop").alias("stop_epoch"))


@query("agg31_class_weights", f"SELECT label, count(*) AS n, round(1.0e0 / count(*), 9) AS weight FROM {LABELS} GROUP BY 1")
def agg31(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(1.0 / F.count("*"), 9).alias("weight"))


@query("agg31_positive_weight", f"SELECT magnification, round(count(*) FILTER (patient_label = 0) / greatest(1, count(*) FILTER (patient_label = 1)), 6) AS pos_weight FROM {PRED} GROUP BY 1")
def agg31_pos(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("magnification").agg(F.round(F.count_if(F.col("patient_label") == 0) / F.greatest(F.lit(1), F.count_if(F.col("patient_label") == 1)), 6).alias("pos_weight"))


_SPLIT = """(SELECT upper(trim(patient_id)) AS patient_id, lower(trim(split)) AS split FROM patient_level_split WHERE trim(patient_id) <> '' QUALIFY row_number() OVER (PARTITION BY upper(trim(patient_id)) ORDER BY assigned_at DESC, row_no DESC) = 1)"""
_MAPPED = "(SELECT DISTINCT upper(trim(slide_id)) AS slide_id, upper(trim(patient_id)) AS patient_id FROM slide_patient_map WHERE trim(slide_id) <> '' AND trim(patient_id) <> '')"


def newest_split(spark, sf_dir):
    """(patient_id, split) by the newest row of each patient."""
    rows = read(spark, sf_dir, "patient_level_split").select(tidy_upper("patient_id").alias("patient_id"), F.struct("assigned_at", "row_no", tidy_lower("split").alias("split")).alias("r")).filter("patient_id IS NOT NULL")
    return rows.groupBy("patient_id").agg(F.max("r").alias("r")).select("patient_id", "r.split")


def mapped(spark, sf_dir):
    """(slide_id, patient_id), distinct."""
    return read(spark, sf_dir, "slide_patient_map").select(tidy_upper("slide_id").alias("slide_id"), tidy_upper("patient_id").alias("patient_id")).filter("slide_id IS NOT NULL AND patient_id IS NOT NULL").distinct()


@query("join11_leakage_check", f"""
WITH k AS (SELECT 'slide_id' AS key_name, slide_id AS key_value, split FROM {_MAPPED} JOIN {_SPLIT} USING (patient_id)
UNION ALL SELECT 'sha256', lower(trim(source_sha256)), split FROM processing JOIN {_SPLIT} s ON s.patient_id = upper(trim(processing.patient_id)) WHERE source_sha256 IS NOT NULL AND NOT regexp_full_match(trim(source_sha256), '0*'))
SELECT key_name, key_value, count(DISTINCT split) AS n_splits FROM k GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def join11(spark, sf_dir):
    """Keys found in more than one split, all keys in one pass."""
    split = newest_split(spark, sf_dir)
    slides = mapped(spark, sf_dir).join(split, "patient_id").select(F.lit("slide_id").alias("key_name"), F.col("slide_id").alias("key_value"), "split")
    digest = tidy_lower("source_sha256")
    images = read(spark, sf_dir, "processing").select(tidy_upper("patient_id").alias("patient_id"), F.when(~digest.rlike(r"\A0*\z"), digest).alias("key_value")).filter("key_value IS NOT NULL")
    images = images.join(split, "patient_id").select(F.lit("sha256").alias("key_name"), "key_value", "split")
    return slides.unionByName(images).groupBy("key_name", "key_value").agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


@query("flt16_slide_conflicts", f"SELECT slide_id, count(*) AS n_patients FROM {_MAPPED} GROUP BY 1 HAVING count(*) > 1")
def flt16(spark, sf_dir):
    return mapped(spark, sf_dir).groupBy("slide_id").agg(F.count("*").alias("n_patients")).filter("n_patients > 1")


@query("flt10_violations", """
SELECT count(*) FILTER (patient_id IS NULL OR trim(patient_id) = '') AS missing_patient, count(*) FILTER (patient_label IS NULL OR patient_label NOT IN (0, 1)) AS bad_label,
count(*) FILTER (y_prob IS NULL OR isnan(y_prob)) AS not_finite, count(*) FILTER (y_prob < 0 OR (y_prob > 1 AND NOT isnan(y_prob))) AS out_of_range, count(DISTINCT patient_label) = 2 AS both_classes FROM patient_level_cv""")
def flt10(spark, sf_dir):
    p = F.col("y_prob")
    rows = read(spark, sf_dir, "patient_level_cv")
    return rows.agg(F.count_if(tidy_upper("patient_id").isNull()).alias("missing_patient"), F.count_if(F.coalesce(~F.col("patient_label").isin(0, 1), F.lit(True))).alias("bad_label"), F.count_if(p.isNull() | F.isnan(p)).alias("not_finite"), F.count_if((p < 0) | ((p > 1) & ~F.isnan(p))).alias("out_of_range"), (F.countDistinct("patient_label") == 2).alias("both_classes"))


@query("join07_tiles_of_split", f"SELECT model_name, count(*) AS n FROM {PRED} WHERE patient_id IN (SELECT patient_id FROM {_SPLIT} WHERE split = 'test') GROUP BY 1")
def join07(spark, sf_dir):
    chosen = newest_split(spark, sf_dir).filter("split = 'test'")
    return predictions(spark, sf_dir).join(chosen, "patient_id", "left_semi").groupBy("model_name").agg(F.count("*").alias("n"))


@query("join08_outside_holdout", f"SELECT model_name, count(*) AS n FROM {PRED} WHERE patient_id NOT IN (SELECT patient_id FROM {_SPLIT} WHERE split = 'test') GROUP BY 1")
def join08(spark, sf_dir):
    chosen = newest_split(spark, sf_dir).filter("split = 'test'")
    return predictions(spark, sf_dir).join(chosen, "patient_id", "left_anti").groupBy("model_name").agg(F.count("*").alias("n"))


@query("set05_split_equality", f"""
SELECT (SELECT count(*) FROM (SELECT patient_id, split FROM {_SPLIT} EXCEPT SELECT upper(trim(patient_id)), lower(trim(split)) FROM patient_level_split)) AS only_saved,
(SELECT count(*) FROM (SELECT DISTINCT upper(trim(patient_id)), lower(trim(split)) FROM patient_level_split WHERE trim(patient_id) <> '' EXCEPT SELECT patient_id, split FROM {_SPLIT})) AS only_requested""")
def set05(spark, sf_dir):
    saved = newest_split(spark, sf_dir)
    asked = read(spark, sf_dir, "patient_level_split").select(tidy_upper("patient_id").alias("patient_id"), tidy_lower("split").alias("split")).filter("patient_id IS NOT NULL").distinct()
    a = saved.exceptAll(asked).agg(F.count("*").alias("only_saved"))
    b = asked.exceptAll(saved).agg(F.count("*").alias("only_requested"))
    return a.crossJoin(b)
