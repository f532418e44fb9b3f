"""Evaluation: confusion, sweep, report, spread, firing rates, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
MAX_BROADCAST_CLASSES = 1000


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, zero where b is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: Column, flagged: Column, *keys: str) -> DataFrame:
    """tp, fn, fp, tn and the ratios made of them, overall or by ``keys``; nulls count as false."""
    t, f = F.coalesce(truth, F.lit(False)), F.coalesce(flagged, F.lit(False))
    out = df.groupBy(*keys).agg(F.count_if(t & f).alias("tp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & f).alias("fp"), F.count_if(~t & ~f).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fn + fp + tn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def threshold_sweep(df: DataFrame, truth: Column, risk: Column, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Confusion at each threshold; the thresholds are a literal array, so the data is read once."""
    slim = df.select(truth.alias("t"), risk.alias("r"))
    return confusion(slim.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds]))), F.col("t"), F.col("r") >= F.col("threshold"), "threshold")


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support, and accuracy."""
    pairs = df.select(F.col(truth).alias("t"), F.col(predicted).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    sides = pairs.select("t", "p", "n", F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("own")), F.struct(F.col("p").alias("label"), F.lit(False).alias("own")))).alias("s"))
    per = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.coalesce(F.sum(F.when(F.col("s.own") & (F.col("t") == F.col("p")), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("s.own"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("s.own"), F.col("n"))), F.lit(0)).alias("named"),
    )
    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("named")), "recall": ratio(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    mean = lambda c: F.avg(c).alias(c)
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    total = F.sum("support").alias("support")
    accuracy = ratio(F.sum("tp"), F.sum("support"))
    names = ("precision", "recall", "f1")
    return (
        per.select("label", *names, "support")
        .unionByName(per.agg(*map(mean, names), total).withColumn("label", F.lit("macro avg")))
        .unionByName(per.agg(*map(weighted, names), total).withColumn("label", F.lit("weighted avg")))
        .unionByName(per.agg(accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), total).withColumn("label", F.lit("accuracy")))
    )


def risk_spread(df: DataFrame, key: str, risk: str) -> DataFrame:
    """Least, upper median (element n div 2 in order) and greatest risk by class.

    The median is exact: a quantile sketch, merged before the shuffle, bounds it
    within ten times the sketch's error, and only the distinct values between the
    bounds, some 0.2 % of a class, are put in order.
    """
    slim = df.select(F.col(key).alias("k"), F.col(risk).cast("double").alias("r")).filter("r is not null")
    ends = slim.groupBy("k").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.floor(F.count("*") / 2).alias("half"), F.percentile_approx("r", [0.499, 0.501], 10_000).alias("near"))
    rows = ends.limit(MAX_BROADCAST_CLASSES + 1).collect()
    if len(rows) <= MAX_BROADCAST_CLASSES:
        ends = F.broadcast(df.sparkSession.createDataFrame(rows, ends.schema))
    both = slim.join(ends, slim["k"].eqNullSafe(ends["k"])).select(slim["k"], "r", "low", "high", "half", "near").filter(F.col("r") <= F.col("near")[1])
    below = F.col("r") < F.col("near")[0]
    # all values under the bounds are one row of each class, at the lower bound's left
    counts = both.groupBy("k", "low", "high", "half", F.when(~below, F.col("r")).alias("r")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("k").orderBy(F.col("r").asc_nulls_first())
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") > F.col("half"))
    return ranked.groupBy("k", "low", "high").agg(F.min("r").alias("med_risk")).select(F.col("k").alias(key), F.col("low").alias("min_risk"), "med_risk", F.col("high").alias("max_risk"))


def firing(df: DataFrame, signals: list[str], truth: Column) -> DataFrame:
    """How often each signal fires on positives and negatives, with one pass and one row per signal."""
    sums = []
    for s in signals:
        sums += [F.count_if(truth & (F.col(s) > 0)).alias(f"{s}__p"), F.count_if(~truth & (F.col(s) > 0)).alias(f"{s}__n")]
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"{s}__p").alias("on_positive"), F.col(f"{s}__n").alias("on_negative")) for s in signals])
    return df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def by_count(rates: DataFrame) -> DataFrame:
    """Signals by how often they fire on positives, most often first, with their place; one row a signal."""
    return rates.withColumn("place", F.row_number().over(Window.orderBy(F.col("on_positive").desc(), "signal"))).orderBy("place")


def never_fired(rates: DataFrame) -> DataFrame:
    return rates.filter((F.col("on_positive") == 0) & (F.col("on_negative") == 0)).select("signal")


def listing(df: DataFrame, truth: Column, risk: str, threshold: float, kind: str) -> DataFrame:
    """missed, caught, false_alarm or cleared cases, in the report's order."""
    flagged = F.col(risk) >= threshold
    rule = {"missed": truth & ~flagged, "caught": truth & flagged, "false_alarm": ~truth & flagged, "cleared": ~truth & ~flagged}[kind]
    return df.filter(rule).orderBy(F.col(risk).asc() if kind == "missed" else F.col(risk).desc())
