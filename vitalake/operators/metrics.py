"""Evaluation of predictions, in passes that shuffle counts and not rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake.session import cut


def confusion(y: Column, pred: Column) -> dict[str, Column]:
    """Aggregates tp, fp, tn and fn."""
    one = lambda a, b: F.sum(((y == a) & (pred == b)).cast("bigint"))
    return {"tp": one(1, 1), "fp": one(0, 1), "tn": one(0, 0), "fn": one(1, 0)}


def _ratio(a: Column, b: Column, none: float | None = 0.0) -> Column:
    r = F.when(b != 0, a / b)
    return r if none is None else F.coalesce(r, F.lit(none))


def scores(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Metrics in percent; a division by zero is 0; balanced accuracy is over the classes there are."""
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    precision = _ratio(tp, tp + fp)
    classes = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return {
        "accuracy": 100 * _ratio(tp + tn, tp + fp + tn + fn),
        "precision": 100 * precision,
        "recall": 100 * recall,
        "specificity": 100 * specificity,
        "f1": 100 * _ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": 100 * _ratio(
            F.when(tp + fn > 0, recall).otherwise(0.0) + F.when(tn + fp > 0, specificity).otherwise(0.0), classes
        ),
        "npv": 100 * _ratio(tn, tn + fn),
    }


def confusion_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and metrics of each group."""
    # Counted before they are filtered, so that what labels are read from is read once a row.
    each = df.groupBy(*by, F.col(y).alias("__y"), F.col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.max(y).alias("y"), F.max(pred).alias("p"))
    one = lambda a, b: F.sum(F.when((F.col("y") == a) & (F.col("p") == b), F.col("n")).otherwise(0))
    counted = each.where("y is not null and p is not null").groupBy(*by).agg(
        one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(0, 0).alias("tn"), one(1, 0).alias("fn")
    )
    return counted.select(*by, "tp", "fp", "tn", "fn", *[v.alias(k) for k, v in scores(*map(F.col, ("tp", "fp", "tn", "fn"))).items()])


def _by_value(df: DataFrame, y: str, score: str) -> DataFrame:
    """``score``, ``pos`` and ``neg``: positives and negatives of each score; null, NaN and other labels are left out.

    Rows are counted before they are filtered, and the filter is on aggregates, as one on the grouping columns would be pushed down to
    the rows: an expression that reads the score from a text is so evaluated once a row.
    """
    each = df.groupBy(F.col(score).alias("__s"), F.col(y).alias("__y")).agg(
        F.count(F.lit(1)).alias("n"), F.max(score).alias("score"), F.max(y).alias("y")
    )
    known = each.where(F.col("y").isin(0, 1) & F.col("score").isNotNull() & ~F.isnan("score"))
    one = lambda k: F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0))
    return known.groupBy("score").agg(one(1).alias("pos"), one(0).alias("neg"))


def by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    """Counts of positives and negatives by distinct score, with those of all higher scores.

    Columns: score, pos, neg, pos_above, neg_above. Scores are in 0 to 1; sums cross blocks of
    scores as one row each, so no task sees all scores.
    """
    counted = cut(_by_value(df, y, score)).withColumn("block", F.floor(F.col("score") * 4096))  # one row a score, used several times
    higher = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # At most 4097 rows.
    offsets = counted.groupBy("block").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "block", F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n0")
    )
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return counted.join(F.broadcast(offsets), "block").select(
        "score", "pos", "neg",
        (F.col("p0") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_above"),
        (F.col("n0") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_above"),
    )


def rank_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """``roc_auc`` (ties count half), ``average_precision`` (steps) and ``auprc_trapezoid``; null with one class only."""
    curve = by_score(df, y, score)
    whole = curve.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    precision = tp / (tp + fp)
    before = F.when(F.col("pos_above") + F.col("neg_above") > 0, F.col("pos_above") / (F.col("pos_above") + F.col("neg_above"))).otherwise(1.0)
    return (
        curve.crossJoin(F.broadcast(whole))  # one row
        .agg(
            F.max("P").alias("P"),
            F.max("N").alias("N"),
            F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)).alias("wins"),
            F.sum(F.col("pos") * precision).alias("ap"),
            F.sum(F.col("pos") * (precision + before) / 2).alias("area"),
        )
        .select(
            F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("wins") / (F.col("P") * F.col("N"))).alias("roc_auc"),
            F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("ap") / F.col("P")).alias("average_precision"),
            F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("area") / F.col("P")).alias("auprc_trapezoid"),
        )
    )


def curve_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """tpr, fpr, precision and recall at each distinct score; none with one class only."""
    curve = by_score(df, y, score)
    whole = curve.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return curve.crossJoin(F.broadcast(whole)).where("P > 0 and N > 0").select(
        F.col("score").alias("threshold"), (tp / F.col("P")).alias("tpr"), (fp / F.col("N")).alias("fpr"),
        (tp / (tp + fp)).alias("precision"), (tp / F.col("P")).alias("recall"),
    )


def threshold_sweep(df: DataFrame, y: str, score: str) -> DataFrame:
    """Counts and metrics at the thresholds 0.01 to 0.99.

    A row is counted once, at the highest threshold that it reaches; sums from the top
    give each threshold's counts, so rows aren't multiplied by thresholds.
    """
    grid = [k / 100 for k in range(1, 100)]
    # The number of thresholds reached, compared as numbers, not by rounding.
    at = F.col("score")
    guess = F.least(F.lit(99), F.greatest(F.lit(0), F.floor(at * 100).cast("int")))
    edge = lambda k: k.cast("double") / 100.0
    reached = F.when((guess < 99) & (edge(guess + 1) <= at), guess + 1).when((guess > 0) & (edge(guess) > at), guess - 1).otherwise(guess)
    counted = _by_value(df, y, score).groupBy(reached.alias("reached")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    levels = df.sparkSession.createDataFrame([(k, t) for k, t in enumerate([0.0, *grid])], "k int, threshold double")
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # 100 rows
    everywhere = Window.partitionBy()
    joined = levels.join(F.broadcast(counted), F.col("k") == F.col("reached"), "left").select(
        "k", "threshold", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n")
    ).select(
        "k", "threshold", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"),
        F.sum("n").over(everywhere).alias("N"), F.sum("p").over(everywhere).alias("P"),
    ).select("k", "threshold", "tp", "fp", (F.col("N") - F.col("fp")).alias("tn"), (F.col("P") - F.col("tp")).alias("fn")).where("k > 0")
    return joined.select("threshold", "tp", "fp", "tn", "fn", *[v.alias(k) for k, v in scores(*map(F.col, ("tp", "fp", "tn", "fn"))).items()])


def pick_threshold(sweep: DataFrame, metric: str = "f1", min_precision: float | None = None) -> DataFrame:
    """The first threshold with the greatest metric, rounded to two places; 0.5 if none has the precision."""
    ok = sweep if min_precision is None else sweep.where(F.round("precision", 2) >= min_precision)
    best = ok.agg(F.min_by("threshold", F.struct(-F.round(metric, 2), "threshold")).alias("t"))
    return best.select(F.coalesce("t", F.lit(0.5)).alias("threshold"))


def calibration(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Count, mean label and mean score of the bins from 0; a score of 1 is in none."""
    edges = [(k + 1) / bins for k in range(bins)]
    of = sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return (
        df.where(F.col(y).isin(0, 1) & F.col(score).isNotNull())
        .withColumn("bin", of)
        .where(F.col("bin") < bins)
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("mean_label"), F.avg(score).alias("mean_score"))
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """``ece`` and ``mce`` of calibration bins."""
    off = F.abs(F.col("mean_label") - F.col("mean_score"))
    return bins.agg((F.sum(F.col("n") * off) / F.sum("n")).alias("ece"), F.max(off).alias("mce"))


def fairness(df: DataFrame, y: str, pred: str, attributes: Sequence[str]) -> DataFrame:
    """Counts and rates of each group of each attribute; a division by zero is null."""
    each = df.groupBy(*attributes, F.col(y).alias("__y"), F.col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.max(y).alias("y"), F.max(pred).alias("p"))
    sets = [F.struct(F.lit(a).alias("sensitive_attribute"), F.col(a).cast("string").alias("group")) for a in attributes]
    long = each.where("y is not null and p is not null").select("y", "p", "n", F.explode(F.array(*sets)).alias("g")).select("y", "p", "n", "g.*").where(F.col("group").isNotNull())
    one = lambda a, b: F.sum(F.when((F.col("y") == a) & (F.col("p") == b), F.col("n")).otherwise(0))
    counted = long.groupBy("sensitive_attribute", "group").agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(0, 0).alias("tn"), one(1, 0).alias("fn"))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return counted.select(
        "sensitive_attribute", "group", "tp", "tn", "fp", "fn",
        _ratio(tp, tp + fn, None).alias("tpr"), _ratio(tn, tn + fp, None).alias("tnr"),
        _ratio(fp, fp + tn, None).alias("fpr"), _ratio(fn, fn + tp, None).alias("fnr"),
        _ratio(tp + fp, n, None).alias("pr"), _ratio(tn + fn, n, None).alias("nr"), _ratio(tp + tn, n, None).alias("accuracy"),
    )


def probability_bins(df: DataFrame, score: str, label: str) -> DataFrame:
    """Right-closed fifths of 0 to 1 with count and mean label; empty ones too."""
    names = ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"]
    of = F.when(F.col(score) <= 0.2, 0).when(F.col(score) <= 0.4, 1).when(F.col(score) <= 0.6, 2).when(F.col(score) <= 0.8, 3).otherwise(4)
    counted = df.where(F.col(score).between(0, 1)).groupBy(of.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("mean_label")
    )
    bins = df.sparkSession.createDataFrame(list(enumerate(names)), "k int, bin string")
    return bins.join(F.broadcast(counted), "k", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_label")


#: Metrics with an interval.
INTERVALS = ("accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy")


def bootstrap(df: DataFrame, y: str, pred: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Metrics of the whole with their bootstrap interval over ``replicates`` resamples of all rows with replacement.

    Metrics follow from the four counts of the confusion, and those of a resample are drawn from the multinomial
    distribution with the shares of the whole: the very distribution of drawing rows. So rows are counted in one pass,
    whatever their number. ``value``, ``low`` and ``high``: the order statistics at 2.5 and 97.5 percent. Rows with a label or
    prediction other than 0 and 1 are left out; without rows there is no result.
    """
    rows = df.where(F.col(y).isin(0, 1) & F.col(pred).isin(0, 1))
    cells = [int(x or 0) for x in rows.agg(*confusion(F.col(y), F.col(pred)).values()).first()]
    spark = df.sparkSession
    n = sum(cells)
    drawn = np.random.default_rng(seed).multinomial(n, np.array(cells) / n, replicates) if n else np.zeros((0, 4), int)
    draws = spark.createDataFrame([tuple(map(int, r)) for r in drawn] or [], "tp bigint, fp bigint, tn bigint, fn bigint")
    own = spark.createDataFrame([tuple(cells)] if n else [], "tp bigint, fp bigint, tn bigint, fn bigint")
    metric = scores(*map(F.col, ("tp", "fp", "tn", "fn")))
    low, high = int(0.025 * replicates) + 1, int(0.975 * replicates) + 1
    whole = own.select(*[metric[m].alias(f"w_{m}") for m in INTERVALS])
    # One row for each replicate.
    ci = draws.agg(*[F.array_sort(F.collect_list(metric[m])).alias(m) for m in INTERVALS])
    return whole.crossJoin(ci).select(
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"w_{m}").alias("value"), F.element_at(m, low).alias("low"), F.element_at(m, high).alias("high"))
            for m in INTERVALS
        ])).alias("x")
    ).select("x.*")


def log_losses(df: DataFrame, y: str, score: str, floor: float = 1e-12) -> DataFrame:
    """Mean log loss, and the sum of its means over positives and over negatives."""
    p = F.least(F.greatest(F.col(score), F.lit(floor)), F.lit(1 - floor))
    loss = F.when(F.col(y) == 1, -F.log(p)).otherwise(-F.log(1 - p))
    rows = df.where(F.col(y).isin(0, 1) & F.col(score).isNotNull())
    return rows.agg(
        F.avg(loss).alias("log_loss"),
        (F.avg(F.when(F.col(y) == 1, loss)) + F.avg(F.when(F.col(y) == 0, loss))).alias("balanced_log_loss"),
    )


def temperature(df: DataFrame, y: str, logit: str, rounds: int = 30) -> float:
    """The temperature that makes divided logits fit the labels best, by Newton's method on sums of one pass a round."""
    rows = df.where(F.col(y).isin(0, 1) & F.col(logit).isNotNull())
    b = 1.0  # the inverse temperature; the loss is convex in it
    for _ in range(rounds):
        z = F.col(logit)
        p = 1 / (1 + F.exp(-b * z))
        g, h = rows.agg(F.sum((p - F.col(y)) * z), F.sum(p * (1 - p) * z * z)).first()
        if not h:
            break
        step = g / h
        b = max(b - step, b / 2, 1e-3)
        if abs(step) < 1e-9:
            break
    return 1 / b


def scaled(df: DataFrame, logit: str, t: float) -> DataFrame:
    """``df`` with ``calibrated``, the probability at temperature ``t``."""
    return df.withColumn("calibrated", 1 / (1 + F.exp(-F.col(logit) / t)))


def confidence_tags(p: Column) -> Column:
    """high_confidence above 0.8 or below 0.2, borderline from 0.4 to 0.6; an array, empty for others."""
    return F.array_compact(F.array(F.when((p > 0.8) | (p < 0.2), "high_confidence"), F.when(p.between(0.4, 0.6), "borderline")))


def two_settings(df: DataFrame, y: str, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts and metrics of each group at 0.5 and at ``threshold``, with the share predicted positive in percent; column ``setting``."""
    out = None
    for name, t in (("default", 0.5), ("tuned", threshold)):
        rows = df.where(F.col(score).isNotNull()).withColumn("__pred", (F.col(score) >= t).cast("int"))
        m = confusion_metrics(rows, y, "__pred", by)
        tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
        m = m.withColumn("positive_rate", 100 * (tp + fp) / (tp + fp + tn + fn)).withColumn("setting", F.lit(name)).withColumn("threshold", F.lit(t))
        out = m if out is None else out.unionByName(m)
    return out


#: Names of models and modes in reports, by how they are written in data; fixed values.
DISPLAY = {"zero_shot": "Zero-Shot", "zero_shot_plus": "Zero-Shot+", "few_shot": "Few-Shot (N=6)", "coagent": "Co-Agent"}


def displayed(c: Column) -> Column:
    """The name in reports; others as words with capitals."""
    known = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))
