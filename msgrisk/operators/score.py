"""Scoring with explanations, verdict bands, batch summary and the gated second opinion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgrisk.functions.lexicons import SIGNAL_LABELS, SIGNALS
from msgrisk.functions.signals import MENTIONS, mentioned
from msgrisk.functions.urls import Suffixes
from msgrisk.operators.vectorize import featurised

# Fixed values.
LEGIT_MAX, FRAUD_MIN, BLOCK_MIN, LOW_CONFIDENCE = 0.4, 0.5, 0.8, 0.6
REVIEW_LOW, REVIEW_HIGH = 0.4, 0.7
MAX_BATCH_ROWS, MAX_CHARS = 500, 2000
# End of fixed values.
NOTE = "the word occurs, but the message does not ask for it"


def verdict(risk: Column) -> Column:
    return (
        F.when(risk.isNull(), "Unscored").when(risk >= BLOCK_MIN, "High-confidence fraud").when(risk >= FRAUD_MIN, "Likely fraud")
        .when(risk <= LEGIT_MAX, "Likely legitimate").otherwise("Inconclusive")
    )


def split_category(risk: Column, confidence: Column) -> Column:
    """The class is unsure although the verdict is not."""
    return F.coalesce(~((risk > LEGIT_MAX) & (risk < FRAUD_MIN)) & (confidence < LOW_CONFIDENCE), F.lit(False))


def batch_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col("risk") >= FRAUD_MIN).alias("n_flagged"))


def needs_review(risk: Column, configured: bool) -> Column:
    return F.lit(configured) & (risk > REVIEW_LOW) & (risk < REVIEW_HIGH)


def risk_signals(coefficients, classes: list[str]) -> Column:
    """All signals with their weight for the predicted class, greatest absolute weight first."""
    rows = []
    for s, name in enumerate(SIGNALS):
        weight = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, float(coefficients[k][len(coefficients[k]) - len(SIGNALS) + s]))]), F.col("prediction"))
        note = F.when((F.col(name) == 0) & mentioned(name, F.col("text")), NOTE) if name in MENTIONS else F.lit(None).cast("string")
        rows.append(F.struct((-F.abs(weight)).alias("_o"), F.lit(s).alias("_i"), F.lit(SIGNAL_LABELS[name]).alias("label"), (F.col(name) > 0).alias("present"), weight.alias("weight"), note.alias("note")))
    ordered = F.array_sort(F.array(*rows))
    return F.transform(ordered, lambda r: F.struct(r["label"].alias("label"), r["present"].alias("present"), r["weight"].alias("weight"), r["note"].alias("note")))


def top_tokens(contributions: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The ``k`` largest contributions by absolute value of each key, zeros dropped after the cut.

    ``contributions``: key, token, contribution. Spark's group limit keeps k rows
    per key and partition before the shuffle.
    """
    order = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "token", "contribution")
    return contributions.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("contribution") != 0))


def classify(df: DataFrame, trained, suffixes: Suffixes) -> DataFrame:
    """label, confidence, risk, verdict, risk_signals and top_tokens for each text.

    A null text has null for all of them, with verdict "Unscored". Columns of the
    input keep their names and values, but those that bear a name of the result
    are replaced.
    """
    import numpy as np

    model, names = trained.model, trained.features.names
    slim = df.select(F.struct(*df.columns).alias("row"), F.col("text").cast("string").alias("text"))
    scored = model.scored(trained.features.transform(featurised(slim, suffixes)))
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(model.coefficients), names, model.classes))

    @F.pandas_udf("struct<token:array<string>,contribution:array<double>>")
    def top(indices: pd.Series, values: pd.Series, label: pd.Series) -> pd.DataFrame:
        w, all_names, classes = shared.value
        row = {c: k for k, c in enumerate(classes)}
        tokens, parts = [], []
        for at, x, c in zip(indices, values, label):
            if at is None:  # a dense vector
                at = np.flatnonzero(x)
                x = np.asarray(x, float)[at]
            at = np.asarray(at, int)
            c = np.asarray(x, float) * w[row[c], at]
            order = np.lexsort((-at, -np.abs(c)))[:5]
            order = order[c[order] != 0]
            tokens.append([all_names[i] for i in at[order]])
            parts.append(c[order].tolist())
        return pd.DataFrame({"token": tokens, "contribution": parts})

    some = F.col("text").isNotNull()
    legit = model.classes.index("legit") if "legit" in model.classes else None
    risk = F.lit(None).cast("double") if legit is None else F.when(some, 1.0 - F.col("probability")[legit])
    scored = scored.withColumn("_v", F.unwrap_udt("features")).withColumn("_t", top(F.col("_v.indices"), F.col("_v.values"), F.col("prediction"))).drop("_v")
    scored = scored.withColumn("risk", risk).withColumn("confidence", F.when(some, F.array_max("probability"))).withColumn("verdict", verdict(F.col("risk")))
    scored = scored.withColumn("risk_signals", F.when(some, risk_signals(np.asarray(model.coefficients), model.classes))).withColumn("top_tokens", F.when(some, F.arrays_zip("_t.token", "_t.contribution").cast("array<struct<token:string,contribution:double>>")))
    made = ("predicted_class", "confidence", "risk", "verdict", "split_category", "risk_signals", "top_tokens")
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in made]
    return scored.select(*kept, F.when(some, F.col("prediction")).alias("predicted_class"), "confidence", "risk", "verdict", split_category(F.col("risk"), F.col("confidence")).alias("split_category"), "risk_signals", "top_tokens")


def classify_one(spark: SparkSession, text: str, trained, suffixes: Suffixes) -> dict:
    """The result for one text of 1 to ``MAX_CHARS`` characters."""
    if not text or not text.strip() or len(text) > MAX_CHARS:
        raise ValueError(f"a text of 1 to {MAX_CHARS} characters is wanted")
    return classify(spark.createDataFrame([(text,)], "text string"), trained, suffixes).first().asDict(recursive=True)


def classify_batch(spark: SparkSession, path: str, trained, suffixes: Suffixes) -> tuple[DataFrame, DataFrame]:
    """The results for an uploaded CSV, by position, and their summary."""
    from msgrisk.sources.io import read_upload

    rows = classify(read_upload(spark, path, MAX_BATCH_ROWS), trained, suffixes).orderBy("pos")
    return rows, batch_summary(rows)


def suite_report(cases: DataFrame, trained, suffixes: Suffixes, floor: float) -> DataFrame:
    """Confusion of ``cases(id, label, family, text)`` at the flagging risk; raises if recall is under ``floor``."""
    from msgrisk.operators.evaluate import confusion

    scored = classify(cases, trained, suffixes)
    report = confusion(scored, F.col("label") == "smish", F.col("risk") >= FRAUD_MIN)
    recall = report.first()["recall"]
    if recall < floor:
        raise ValueError(f"recall {recall:.3f} is under the floor {floor}")
    return report


def valid_opinion(body: Column) -> Column:
    """A reply's verdict, confidence and reasoning; null if anything is off."""
    r = F.from_json(body, "verdict string, confidence double, reasoning string")
    ok = r["verdict"].isin("fraud", "legit") & r["confidence"].between(0.0, 1.0) & r["reasoning"].isNotNull()
    return F.when(ok, r)


def review(df: DataFrame, ask: Callable[[str], str | None] | None) -> DataFrame:
    """Adds ``llm_opinion`` for rows in the band; ``ask`` is called per text and may fail freely."""
    if ask is None:
        return df.withColumn("llm_opinion", F.lit(None).cast("struct<verdict:string,confidence:double,reasoning:string>"))

    def call(text):
        try:
            return None if text is None else ask(text)
        except Exception:  # a second opinion must never break scoring
            return None

    wanted = F.when(needs_review(F.col("risk"), True), F.col("text"))
    return df.withColumn("llm_opinion", valid_opinion(F.udf(call, "string", useArrow=False)(wanted)))


def meta(classes: list[str], review_available: bool = False) -> dict:
    return {
        "low_confidence_threshold": LOW_CONFIDENCE, "risk_fraud_threshold": FRAUD_MIN, "risk_legit_threshold": LEGIT_MAX, "risk_block_threshold": BLOCK_MIN,
        "max_batch_rows": MAX_BATCH_ROWS, "labels": sorted(classes), "llm_review_available": review_available,
    }
