"""Evaluation of detectors and classifiers: curves, thresholds, reports.

Curves start from counts per distinct score; running totals over the scores use
range partitions, so neither many scores nor one large group meets one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.operators.ordering import exact_percentile, running_totals, with_scalars

BETAS = (0.25, 0.5, 1.0, 2.0, 3.0)


def _join(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key totals; without keys ``side`` has one row, or none if it was filtered away."""
    return df.join(side, list(keys)) if keys else with_scalars(df, side).filter(F.col(side.columns[0]).isNotNull())


def curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Counts at every distinct score, highest first: threshold, pos/neg at it, tp/fp at or above it, p/n in all.

    Null scores are dropped; groups without both classes are left out.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    y = F.col(label).cast("int")
    table = rows.groupBy(*keys, F.col(score).alias("threshold")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    table = running_totals(table, keys, [F.col("threshold").desc()], {"tp": "pos", "fp": "neg"}, parts)
    # from the stored table of distinct scores, not from the rows again
    totals = table.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).filter((F.col("p") > 0) & (F.col("n") > 0))
    return _join(table, totals, keys)


def roc_curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """All points of the ROC curve, collinear ones too, with the (0, 0) point at infinity."""
    c = curve(df, score, label, keys, parts)
    points = c.select(*keys, "threshold", (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))
    start = c.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).distinct()
    return start.unionByName(points)


def pr_curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    c = curve(df, score, label, keys, parts)
    return c.select(*keys, "threshold", precision().alias("precision"), recall().alias("recall"))


def precision() -> Column:
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def recall() -> Column:
    return F.col("tp") / F.col("p")


def f_beta(beta: float) -> Column:
    b2 = beta * beta
    return (1 + b2) * (precision() * recall()) / (b2 * precision() + recall() + 1e-8)


def auc() -> Column:
    """Trapezoid area over a curve table; each row knows its own step."""
    return F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0 / F.col("p") / F.col("n"))


def average_precision_agg() -> Column:
    return F.sum(F.col("pos") / F.col("p") * precision())


def curve_scores(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """AUC, average precision and prevalence (the AP of a random scorer)."""
    c = curve(df, score, label, keys, parts)
    share = F.max(F.col("p") / (F.col("p") + F.col("n")))
    return c.groupBy(*keys).agg(auc().alias("auc"), average_precision_agg().alias("ap"), share.alias("random_ap"))


def best_thresholds(df: DataFrame, score: str, label: str, betas: Sequence[float] = BETAS, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Threshold with the largest F-beta per beta; the lowest one on ties."""
    c = curve(df, score, label, keys, parts)
    options = F.array(*[F.struct(F.lit(float(b)).alias("beta"), f_beta(b).alias("f")) for b in betas])
    rows = c.select(*keys, "threshold", F.explode(options).alias("_o")).select(*keys, "threshold", "_o.beta", "_o.f")
    return rows.groupBy(*keys, "beta").agg(F.max_by("threshold", F.struct("f", -F.col("threshold"))).alias("threshold"), F.max("f").alias("f"))


def youden_threshold(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one on ties, infinity if nothing beats zero."""
    points = roc_curve(df, score, label, keys, parts)
    gain = F.round(F.col("tpr") - F.col("fpr"), 12)
    return points.groupBy(*keys).agg(F.max_by("threshold", F.struct(gain, F.col("threshold"))).alias("threshold"), F.max(gain).alias("gain"))


def cost_threshold(df: DataFrame, score: str, label: str, fp_cost: float = 0.4, fn_cost: float = 0.6, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Threshold with the lowest weighted error rate; the highest one on ties."""
    points = roc_curve(df, score, label, keys, parts)
    cost = F.round(fp_cost * F.col("fpr") + fn_cost * (1 - F.col("tpr")), 12)
    return points.groupBy(*keys).agg(F.min_by("threshold", F.struct(cost, -F.col("threshold"))).alias("threshold"), F.min(cost).alias("cost"))


def site_thresholds(df: DataFrame, score: str, label: str, site: str, beta: float = 2.0, percentile: float = 0.99) -> DataFrame:
    """Per site: the F-beta threshold, or a high percentile of its empty scores where it has no positives."""
    rows = df.filter(F.col(score).isNotNull())
    counts = rows.groupBy(site).agg(F.count_if(F.col(label).cast("int") == 1).alias("_p"), F.min(score).alias("_min"))
    bare = rows.join(counts.filter(F.col("_p") == 0).select(site), site, "left_semi")
    empty = counts.join(exact_percentile(bare, [site], score, percentile, "_q"), site, "left")
    best = best_thresholds(rows, score, label, [beta], [site]).select(site, F.col("threshold").alias("_t"))
    use_percentile = F.col("_p") == 0
    # a site with positives only has no curve; every score is a hit, so the lowest one is the threshold
    j = empty.join(best, site, "left")
    return j.select(site, F.when(use_percentile, F.col("_q")).otherwise(F.coalesce("_t", "_min")).alias("threshold"),
                    F.when(use_percentile, "percentile").otherwise("f_beta").alias("rule"))


def one_class_threshold(df: DataFrame, score: str, keys: Sequence[str] = (), q: float = 0.99) -> DataFrame:
    return exact_percentile(df, keys, score, q, "threshold")


def class_scores(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per class (0 where undefined), over all classes seen as truth or prediction."""
    counts = df.groupBy(*keys, true, pred).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col(true).eqNullSafe(F.col(pred)), F.col("_n")).otherwise(0)
    a = counts.select(*keys, F.col(true).alias("class"), hit.alias("_tp"), F.lit(0).cast("long").alias("_pred"), F.col("_n").alias("_true"))
    b = counts.select(*keys, F.col(pred).alias("class"), F.lit(0).cast("long").alias("_tp"), F.col("_n").alias("_pred"), F.lit(0).cast("long").alias("_true"))
    s = a.unionByName(b).groupBy(*keys, "class").agg(F.sum("_tp").alias("tp"), F.sum("_pred").alias("predicted"), F.sum("_true").alias("support"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    s = s.withColumns({"precision": zero(F.col("tp") / F.nullif(F.col("predicted"), F.lit(0))), "recall": zero(F.col("tp") / F.nullif(F.col("support"), F.lit(0)))})
    return s.withColumn("f1", zero(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def classification_report(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall, F1."""
    return class_scores(df, true, pred, keys).groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").alias("rows"))


def confusion(df: DataFrame, true: str, pred: str, classes: DataFrame | None = None, confidence: str | None = None, above: float = 0.0) -> DataFrame:
    """Long confusion table: true, pred, n, pct of the true class (0 for classes without rows).

    Only rows with confidence strictly above ``above`` count. ``classes`` (column ``class``)
    adds zero cells; it is the label list, whose square is the table itself.
    """
    rows = df if confidence is None else df.filter(F.col(confidence) > above)
    counts = rows.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    if classes is not None:
        labels = classes.select("class").distinct()
        cells = labels.agg(F.collect_set("class").alias("_c")).select(F.explode("_c").alias("true"), "_c").select("true", F.explode("_c").alias("pred"))
        counts = cells.join(counts, ["true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    sums = counts.groupBy("true").agg(F.sum("n").alias("_t"))
    return counts.join(sums, "true").withColumn("pct", F.coalesce(F.col("n") / F.nullif(F.col("_t"), F.lit(0)) * 100, F.lit(0.0))).drop("_t")


def confusion_wide(cells: DataFrame, classes: Sequence[str], value: str = "n", predicted_rows: bool = True) -> DataFrame:
    """Matrix form; rows are predicted classes (or true ones with ``predicted_rows=False``)."""
    row, col = ("pred", "true") if predicted_rows else ("true", "pred")
    return cells.groupBy(row).pivot(col, list(classes)).agg(F.first(value))


def grouped_report(df: DataFrame, true: str, pred: str, groups: Mapping[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Report after mapping classes to groups. Pairs with an ungrouped class are dropped together and counted."""
    pairs = [F.lit(x) for g, names in groups.items() for n in names for x in (n, g)]
    group_of = lambda c: F.try_element_at(F.create_map(*pairs), F.col(c))
    d = df.withColumns({"_t": group_of(true), "_p": group_of(pred)})
    kept = F.col("_t").isNotNull() & F.col("_p").isNotNull()
    report = classification_report(d.filter(kept), "_t", "_p", keys)
    dropped = d.groupBy(*keys).agg(F.count_if(~kept).alias("dropped"))
    return _join(report, dropped, keys)


def multi_level_eval(levels: Mapping[str, DataFrame], score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """AUC, AP, F1 threshold and Youden threshold for tile, patch and crop scores, one row per level."""
    rows = reduce(DataFrame.unionByName, [
        d.select(F.lit(n).alias("level"), *keys, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label")) for n, d in levels.items()])
    by = ["level", *keys]
    c = curve(rows, "score", "label", by)
    gain = F.round(F.col("tp") / F.col("p") - F.col("fp") / F.col("n"), 12)
    f1 = f_beta(1.0)
    out = c.groupBy(*by).agg(
        F.max("p").alias("positives"), F.max("n").alias("negatives"), auc().alias("auc"), average_precision_agg().alias("ap"),
        F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias("f1_threshold"),
        F.max_by("threshold", F.struct(gain, F.col("threshold"))).alias("_y"), F.max(gain).alias("_g"))
    return out.withColumn("youden_threshold", F.when(F.col("_g") > 0, F.col("_y")).otherwise(F.lit(float("inf")))).drop("_y", "_g")


def compare_scorers(df: DataFrame, scorers: Sequence[str], label: str, site: str) -> DataFrame:
    """AUC, AP and prevalence of each score column, overall and per site that has both classes."""
    stacked = F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).cast("double").alias("value")) for s in scorers])
    rows = df.select(F.explode(F.array(F.lit("All"), F.col(site).cast("string"))).alias("group"), F.col(label).alias("y"), stacked.alias("_s"))
    rows = rows.select("group", "y", F.explode("_s").alias("_s")).select("group", "y", "_s.scorer", "_s.value")
    return curve_scores(rows, "value", "y", ["group", "scorer"])


def drift(ref: DataFrame, cand: DataFrame, key: Sequence[str], score: str, label: str) -> DataFrame:
    """Largest score difference and share of equal top classes between two runs."""
    j = ref.select(*key, F.col(score).alias("_a"), F.col(label).alias("_la")).join(cand.select(*key, F.col(score).alias("_b"), F.col(label).alias("_lb")), list(key))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"),
                 F.avg(F.col("_la").eqNullSafe(F.col("_lb")).cast("int")).alias("top1_agreement"))


def best_epoch(log: DataFrame, keys: Sequence[str], epoch: str, loss: str, f1: str) -> DataFrame:
    """First epoch with the lowest validation loss and first one with the highest F1."""
    return log.groupBy(*keys).agg(
        F.min_by(epoch, F.struct(loss, epoch)).alias("best_loss_epoch"), F.min(loss).alias("best_loss"),
        F.max_by(epoch, F.struct(F.col(f1), -F.col(epoch))).alias("best_f1_epoch"), F.max(f1).alias("best_f1"))
