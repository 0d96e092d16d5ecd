"""Queries on detector and classifier evaluation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import evaluate as E
from tidewrack.operators import grids as G
from tidewrack.operators import joins as J
from tidewrack.plans.grid import MATCHED
from tidewrack.plans.registry import query
from tidewrack.plans.standins import Tables


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# counts per distinct score and running totals, per site
CURVE = """
tab AS (SELECT site, score AS threshold, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg FROM v_scores GROUP BY site, score),
cur AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY site) AS p, SUM(neg) OVER (PARTITION BY site) AS n FROM tab
  WINDOW w AS (PARTITION BY site ORDER BY threshold DESC)),
roc AS (SELECT site, threshold, fp / CAST(n AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr FROM cur UNION ALL SELECT DISTINCT site, 'Infinity'::DOUBLE, 0, 0 FROM cur),
pr AS (SELECT site, threshold, pos, p, tp / CAST(tp + fp AS DOUBLE) AS prec, tp / CAST(p AS DOUBLE) AS rec FROM cur)"""


@query("E1_roc_curve", f"WITH {CURVE} SELECT site, CASE WHEN isinf(threshold) THEN -1 ELSE threshold END AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def roc_curve(t: Tables) -> DataFrame:
    out = E.roc_curve(t.v_scores, "score", "label", ["site"])
    return _r(out.withColumn("threshold", F.when(F.col("threshold") == float("inf"), -1.0).otherwise(F.col("threshold"))), "fpr", "tpr")


@query("E1_auc", """SELECT site, round(SUM(CASE WHEN a.score > b.score THEN a.n * b.n WHEN a.score = b.score THEN a.n * b.n / 2.0::DOUBLE ELSE 0 END) / SUM(a.n * b.n), 6) AS auc,
  round(MAX(prev), 6) AS random_ap FROM (SELECT site, score, COUNT(*) AS n FROM v_scores WHERE label = 1 GROUP BY ALL) a JOIN (SELECT site, score, COUNT(*) AS n FROM v_scores WHERE label = 0 GROUP BY ALL) b USING (site)
  JOIN (SELECT site, AVG(label) AS prev FROM v_scores GROUP BY site) s USING (site) GROUP BY site""")
def auc(t: Tables) -> DataFrame:
    return _r(E.curve_scores(t.v_scores, "score", "label", ["site"]).drop("ap"), "auc", "random_ap")


@query("E2_pr_curve", f"WITH {CURVE} SELECT site, threshold, round(prec, 6) AS precision, round(rec, 6) AS recall FROM pr")
def pr_curve(t: Tables) -> DataFrame:
    return _r(E.pr_curve(t.v_scores, "score", "label", ["site"]), "precision", "recall")


@query("E2_average_precision", f"WITH {CURVE} SELECT round(SUM(pos / CAST(p AS DOUBLE) * prec), 6) AS ap, site FROM pr GROUP BY site")
def average_precision(t: Tables) -> DataFrame:
    return _r(E.curve_scores(t.v_scores, "score", "label", ["site"]).select("site", "ap"), "ap")


@query("E3_best_threshold", f"""WITH {CURVE}, f AS (SELECT site, b.beta, threshold, (1 + b.beta * b.beta) * (prec * rec) / (b.beta * b.beta * prec + rec + 1e-8) AS f FROM pr, (VALUES (0.25::DOUBLE), (0.5), (1), (2), (3)) b(beta))
SELECT site, beta, threshold, round(f, 6) AS f FROM f QUALIFY row_number() OVER (PARTITION BY site, beta ORDER BY f DESC, threshold) = 1""")
def best_threshold(t: Tables) -> DataFrame:
    return _r(E.best_thresholds(t.v_scores, "score", "label", keys=["site"]), "f")


@query("E4_youden_threshold", f"WITH {CURVE} SELECT site, threshold, round(tpr - fpr, 6) AS gain FROM roc QUALIFY row_number() OVER (PARTITION BY site ORDER BY round(tpr - fpr, 12) DESC, threshold DESC) = 1")
def youden_threshold(t: Tables) -> DataFrame:
    return _r(E.youden_threshold(t.v_scores, "score", "label", ["site"]), "gain")


@query("E4_cost_threshold", f"""WITH {CURVE} SELECT site, threshold, round(0.4::DOUBLE * fpr + 0.6::DOUBLE * (1 - tpr), 6) AS cost FROM roc
QUALIFY row_number() OVER (PARTITION BY site ORDER BY round(0.4::DOUBLE * fpr + 0.6::DOUBLE * (1 - tpr), 12), threshold DESC) = 1""")
def cost_threshold(t: Tables) -> DataFrame:
    return _r(E.cost_threshold(t.v_scores, "score", "label", keys=["site"]), "cost")


# here the priority is the site; two sites have no positives
SITES = "st AS (SELECT o_orderpriority AS site, (o_orderkey * 31 % 200) / 200.0::DOUBLE AS score, CASE WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN 0 WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS label FROM orders)"


@query("E5_empty_percentile_threshold", f"""WITH {SITES},
tab AS (SELECT site, score AS threshold, SUM(label) AS pos, SUM(1 - label) AS neg FROM st GROUP BY site, score),
cur AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY site) AS p FROM tab WINDOW w AS (PARTITION BY site ORDER BY threshold DESC)),
f AS (SELECT site, threshold, 5 * (tp / CAST(tp + fp AS DOUBLE) * (tp / CAST(p AS DOUBLE))) / (4 * (tp / CAST(tp + fp AS DOUBLE)) + tp / CAST(p AS DOUBLE) + 1e-8) AS f FROM cur WHERE p > 0)
SELECT site, threshold, 'f_beta' AS rule FROM f QUALIFY row_number() OVER (PARTITION BY site ORDER BY f DESC, threshold) = 1
UNION ALL SELECT site, round(quantile_cont(score, 0.99), 6), 'percentile' FROM st GROUP BY site HAVING SUM(label) = 0""")
def empty_percentile_threshold(t: Tables) -> DataFrame:
    bare = F.col("o_orderpriority").isin("2-HIGH", "5-LOW")
    rows = t.orders.select(F.col("o_orderpriority").alias("site"), (F.col("o_orderkey") * 31 % 200 / 200).alias("score"),
                           F.when(bare, 0).when(F.col("o_custkey") % 4 == 0, 1).otherwise(0).alias("label"))
    return _r(E.site_thresholds(rows, "score", "label", "site"), "threshold")


@query("E5_one_class_threshold", "SELECT site, round(quantile_cont(score, 0.99), 6) AS threshold FROM v_scores WHERE label = 0 GROUP BY site")
def one_class_threshold(t: Tables) -> DataFrame:
    return _r(E.one_class_threshold(t.v_scores.filter("label = 0"), "score", ["site"]), "threshold")


REPORT = """
cls AS (SELECT true_label AS c FROM {src} UNION SELECT pred_label FROM {src}),
per AS (SELECT c, (SELECT COUNT(*) FROM {src} WHERE true_label = c AND pred_label = c) AS tp, (SELECT COUNT(*) FROM {src} WHERE pred_label = c) AS pr, (SELECT COUNT(*) FROM {src} WHERE true_label = c) AS tr FROM cls),
pf AS (SELECT *, CASE WHEN pr = 0 THEN 0 ELSE tp / CAST(pr AS DOUBLE) END AS prec, CASE WHEN tr = 0 THEN 0 ELSE tp / CAST(tr AS DOUBLE) END AS rec FROM per)"""
REPORT_OUT = """round(SUM(tp) / CAST(SUM(tr) AS DOUBLE), 6) AS accuracy, round(AVG(prec), 6) AS precision, round(AVG(rec), 6) AS recall,
  round(AVG(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END), 6) AS f1, CAST(SUM(tr) AS BIGINT) AS rows"""


@query("E6_classification_report", f"WITH {REPORT.format(src='v_pred_class')} SELECT {REPORT_OUT} FROM pf")
def classification_report(t: Tables) -> DataFrame:
    return _r(E.classification_report(t.v_pred_class, "true_label", "pred_label"), "accuracy", "precision", "recall", "f1")


@query("E7_confusion", """
WITH c AS (SELECT DISTINCT true_label AS c FROM v_pred_class), n AS (SELECT true_label, pred_label, COUNT(*) AS n FROM v_pred_class WHERE confidence > 0.9::DOUBLE GROUP BY 1, 2)
SELECT a.c AS true, b.c AS pred, coalesce(n.n, 0) AS n, coalesce(round(100.0::DOUBLE * coalesce(n.n, 0) / nullif(SUM(coalesce(n.n, 0)) OVER (PARTITION BY a.c), 0), 6), 0) AS pct
FROM c a CROSS JOIN c b LEFT JOIN n ON n.true_label = a.c AND n.pred_label = b.c""")
def confusion(t: Tables) -> DataFrame:
    classes = t.v_pred_class.select(F.col("true_label").alias("class"))
    return _r(E.confusion(t.v_pred_class, "true_label", "pred_label", classes, "confidence", 0.9), "pct")


@query("E7_confusion_matrix", """
SELECT pred_label AS pred, """ + ", ".join(f"nullif(COUNT(*) FILTER (WHERE true_label = '{c}'), 0) AS \"{c}\"" for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM v_pred_class GROUP BY 1")
def confusion_matrix(t: Tables) -> DataFrame:
    cells = E.confusion(t.v_pred_class, "true_label", "pred_label")
    return E.confusion_wide(cells, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


GROUPS = {"fast": ["1-URGENT", "2-HIGH"], "slow": ["3-MEDIUM", "5-LOW"]}


@query("E8_grouped_report", f"""WITH m AS (SELECT CASE WHEN true_label IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN true_label IN ('3-MEDIUM', '5-LOW') THEN 'slow' END AS true_label,
  CASE WHEN pred_label IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN pred_label IN ('3-MEDIUM', '5-LOW') THEN 'slow' END AS pred_label FROM v_pred_class),
k AS (SELECT * FROM m WHERE true_label IS NOT NULL AND pred_label IS NOT NULL), {REPORT.format(src='k')}
SELECT {REPORT_OUT}, (SELECT COUNT(*) FROM m WHERE true_label IS NULL OR pred_label IS NULL) AS dropped FROM pf""")
def grouped_report(t: Tables) -> DataFrame:
    return _r(E.grouped_report(t.v_pred_class, "true_label", "pred_label", GROUPS), "accuracy", "precision", "recall", "f1")


LEVELS = MATCHED + """,
boxed AS (SELECT DISTINCT CAST(floor(image_id / CAST(200 AS DOUBLE)) AS BIGINT) AS frame_id, y0, x0, y1, x1 FROM v_manual),
til AS (SELECT 'tile' AS level, t.score, CASE WHEN EXISTS (SELECT 1 FROM boxed s WHERE s.frame_id = t.frame_id AND s.y0 < (t.grid_row * 2 + t.offset_idx) * 8 + 16 AND s.y1 > (t.grid_row * 2 + t.offset_idx) * 8
   AND s.x0 < (t.grid_col * 2 + t.offset_idx) * 8 + 16 AND s.x1 > (t.grid_col * 2 + t.offset_idx) * 8) THEN 1 ELSE 0 END AS label FROM v_tile_score t),
pat AS (SELECT 'patch' AS level, m.score, CASE WHEN EXISTS (SELECT 1 FROM boxed s WHERE s.frame_id = m.frame_id AND s.y0 < m.r * 8 + 8 AND s.y1 > m.r * 8 AND s.x0 < m.c * 8 + 8 AND s.x1 > m.c * 8) THEN 1 ELSE 0 END AS label FROM v_map m),
lev AS (SELECT * FROM til UNION ALL SELECT * FROM pat UNION ALL SELECT 'crop', peak, CASE WHEN label_manual THEN 1 ELSE 0 END FROM matched WHERE peak IS NOT NULL),
tab AS (SELECT level, round(score, 9) AS threshold, SUM(label) AS pos, SUM(1 - label) AS neg FROM lev GROUP BY 1, 2),
cur AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY level) AS p, SUM(neg) OVER (PARTITION BY level) AS n FROM tab WINDOW w AS (PARTITION BY level ORDER BY threshold DESC)),
pr AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS prec, tp / CAST(p AS DOUBLE) AS rec FROM cur)
SELECT level, CAST(MAX(p) AS BIGINT) AS positives, CAST(MAX(n) AS BIGINT) AS negatives, round(SUM(neg * (2 * tp - pos) / 2.0::DOUBLE / p / n), 6) AS auc, round(SUM(pos / CAST(p AS DOUBLE) * prec), 6) AS ap,
  round(arg_max(threshold, (2 * (prec * rec) / (prec + rec + 1e-8), -threshold)), 6) AS f1_threshold, round(arg_max(threshold, (round(tp / CAST(p AS DOUBLE) - fp / CAST(n AS DOUBLE), 12), threshold)), 6) AS youden_threshold FROM pr GROUP BY level"""


@query("E9_multi_granularity_eval", LEVELS)
def multi_granularity_eval(t: Tables) -> DataFrame:
    return _levels(t, t.v_manual)


query("E9_multi_granularity_eval_full", LEVELS)(multi_granularity_eval)


def _levels(t: Tables, manual: DataFrame) -> DataFrame:
    """Tiles and patches labelled by the boxes of ``manual``."""
    boxes = manual.select(F.floor(F.col("image_id") / 200).alias("frame_id"), "y0", "x0", "y1", "x1")
    runs = G.rect_slabs(boxes, ["frame_id"])
    box = lambda d, y, x, side: d.withColumns({"y0": y.cast("long"), "x0": x.cast("long"), "y1": (y + side).cast("long"), "x1": (x + side).cast("long")})
    at = lambda g: (F.col(g) * 2 + F.col("offset_idx")) * 8
    tiles = box(t.v_tile_score.select("frame_id", "grid_row", "grid_col", "offset_idx", "score"), at("grid_row"), at("grid_col"), 16)
    tiles = tiles.withColumn("tile_id", F.concat_ws("_", "grid_row", "grid_col", "offset_idx"))
    patches = box(G.patch_map(t.v_tile_score, 2, 16, fill=False), F.col("r") * 8, F.col("c") * 8, 8).withColumn("tile_id", F.concat_ws("_", "r", "c"))
    score = F.round("score", 9).alias("score")
    mark = lambda d: J.tile_mask_overlap(d, runs, "frame_id", "tile_id", band=64).select(score, (F.col("mask_px") > 0).cast("int").alias("label"))
    crops = G.match_crops(t.v_pred, t.v_manual).select(F.col("peak").alias("score"), F.col("label_manual").cast("int").alias("label"))
    return _r(E.multi_level_eval({"tile": mark(tiles), "patch": mark(patches), "crop": crops}), "auc", "ap", "f1_threshold", "youden_threshold")


@query("E10_compare_scorers", """
WITH s AS (SELECT 'All' AS grp, * FROM v_scores UNION ALL SELECT site, * FROM v_scores), u AS (SELECT grp, 'score' AS scorer, score AS v, label FROM s UNION ALL SELECT grp, 'line', CAST(l_linenumber AS DOUBLE), label FROM s),
tab AS (SELECT grp, scorer, v, SUM(label) AS pos, SUM(1 - label) AS neg FROM u GROUP BY 1, 2, 3),
cur AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY grp, scorer) AS p, SUM(neg) OVER (PARTITION BY grp, scorer) AS n FROM tab WINDOW w AS (PARTITION BY grp, scorer ORDER BY v DESC))
SELECT grp AS "group", scorer, round(SUM(neg * (2 * tp - pos) / 2.0::DOUBLE / p / n), 6) AS auc, round(SUM(pos / CAST(p AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE))), 6) AS ap, round(MAX(p / CAST(p + n AS DOUBLE)), 6) AS random_ap FROM cur GROUP BY 1, 2""")
def compare_scorers(t: Tables) -> DataFrame:
    rows = t.v_scores.withColumn("line", F.col("l_linenumber"))
    return _r(E.compare_scorers(rows, ["score", "line"], "label", "site"), "auc", "ap", "random_ap")


@query("E11_drift", """SELECT COUNT(*) AS rows, round(MAX(abs(confidence - o_orderkey % 100 / 100.0::DOUBLE)), 6) AS max_abs_diff, round(AVG(CASE WHEN true_label = pred_label THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1_agreement FROM v_pred_class""")
def drift(t: Tables) -> DataFrame:
    ref = t.v_pred_class.select("o_orderkey", "confidence", F.col("true_label").alias("top"))
    cand = t.v_pred_class.select("o_orderkey", (F.col("o_orderkey") % 100 / 100).alias("confidence"), F.col("pred_label").alias("top"))
    return _r(E.drift(ref, cand, ["o_orderkey"], "confidence", "top"), "max_abs_diff", "top1_agreement")


@query("E12_training_curves", """
WITH l AS (SELECT o_orderpriority AS run, year(o_orderdate) * 12 + month(o_orderdate) AS epoch, round(AVG(o_totalprice), 3) AS loss, round(AVG(o_custkey % 100), 3) AS f1 FROM orders GROUP BY 1, 2)
SELECT run, arg_min(epoch, (loss, epoch)) AS best_loss_epoch, MIN(loss) AS best_loss, arg_max(epoch, (f1, -epoch)) AS best_f1_epoch, MAX(f1) AS best_f1 FROM l GROUP BY run""")
def training_curves(t: Tables) -> DataFrame:
    log = t.orders.groupBy(F.col("o_orderpriority").alias("run"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("epoch")).agg(
        F.round(F.avg("o_totalprice"), 3).alias("loss"), F.round(F.avg(F.col("o_custkey") % 100), 3).alias("f1"))
    return E.best_epoch(log, ["run"], "epoch", "loss", "f1")
