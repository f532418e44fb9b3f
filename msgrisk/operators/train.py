"""Training with leakage-controlled splits, three classifiers, calibration and selection."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.operators.evaluate import classification_report
from msgrisk.operators.evasion import augment, obfuscate
from msgrisk.operators.importer import group_split
from msgrisk.operators.vectorize import FeatureModel, featurised, fit_features
from msgrisk.functions.urls import Suffixes
from msgrisk.sources.io import settled

MIN_ROWS = 50


@dataclass
class Linear:
    """One coefficient row and intercept per class; Platt pairs if calibrated by sigmoid, softmax otherwise."""

    classes: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray
    kind: str  # softmax, margin or sigmoid
    platt: np.ndarray | None = None

    def scored(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (array by class; null for margins alone) and ``prediction`` (label)."""
        shared = df.sparkSession.sparkContext.broadcast((self.coefficients, self.intercepts, self.platt, self.kind))

        @F.pandas_udf("array<double>")
        def values(indices, vals):
            import pandas as pd

            w, b, platt, kind = shared.value
            out = []
            for i, v in zip(indices, vals):
                if i is None:  # a dense vector
                    i = np.flatnonzero(v)
                    v = np.asarray(v, float)[i]
                z = w[:, np.asarray(i, int)] @ np.asarray(v, float) + b if len(i) else b.copy()
                if kind == "softmax":
                    z = np.exp(z - z.max())
                    z /= z.sum()
                elif kind == "sigmoid":
                    z = 1 / (1 + np.exp(np.clip(platt[:, 0] * z + platt[:, 1], -30, 30)))
                    z = z / max(z.sum(), 1e-12)
                out.append(z.tolist())
            return pd.Series(out)

        df = df.withColumn("_p", F.unwrap_udt("features")).withColumn("_z", values(F.col("_p.indices"), F.col("_p.values"))).drop("_p")
        names = F.array(*[F.lit(c) for c in self.classes])
        df = df.withColumn("prediction", F.element_at(names, F.array_position("_z", F.array_max("_z")).cast("int")))
        return df.withColumn("probability", F.lit(None).cast("array<double>") if self.kind == "margin" else F.col("_z")).drop("_z")


def indexed(df: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    return df.withColumn("_y", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double"))


def logistic(df: DataFrame, classes: list[str], max_iter: int = 100, weight: str | None = None) -> Linear:
    n = df.count()
    lr = LogisticRegression(featuresCol="features", labelCol="_y", family="multinomial", standardization=False, regParam=1.0 / n, maxIter=max_iter)
    m = (lr.setWeightCol(weight) if weight else lr).fit(df)
    return Linear(classes, m.coefficientMatrix.toArray(), m.interceptVector.toArray(), "softmax")


def margins(df: DataFrame, classes: list[str], max_iter: int = 40) -> Linear:
    """One support vector machine against the rest for each class."""
    n = df.count()
    rows, cuts = [], []
    for k in range(len(classes)):
        m = LinearSVC(featuresCol="features", labelCol="_b", regParam=1.0 / n, standardization=False, maxIter=max_iter).fit(df.withColumn("_b", (F.col("_y") == k).cast("double")))
        rows.append(m.coefficients.toArray())
        cuts.append(m.intercept)
    return Linear(classes, np.array(rows), np.array(cuts), "margin")


def calibrated(df: DataFrame, classes: list[str], key: str, folds: int = 5, max_iter: int = 40) -> list[Linear]:
    """Per fold: margins on the rest, then a sigmoid per class fitted on the fold. Predict by the mean."""
    out = []
    for f in range(folds):
        own = F.pmod(F.xxhash64(F.lit(f"fold{key}"), F.col(key)), F.lit(folds)) == f
        svm = margins(df.filter(~own), classes, max_iter)
        held = Linear(classes, svm.coefficients, svm.intercepts, "raw").scored(df.filter(own)).select("_y", F.col("probability").alias("z"))
        platt = []
        for k in range(len(classes)):
            one = held.select((F.col("_y") == k).cast("double").alias("y"), F.array(F.col("z")[k]).alias("x"))
            fit = LogisticRegression(labelCol="y", featuresCol="v", maxIter=50).fit(one.withColumn("v", array_to_vector("x")))
            platt.append((-float(fit.coefficients[0]), -float(fit.intercept)))
        out.append(Linear(classes, svm.coefficients, svm.intercepts, "sigmoid", np.array(platt)))
    return out


class Ensemble:
    """Mean of calibrated folds, with the interface of one model."""

    def __init__(self, members: list[Linear]):
        self.members, self.classes = members, members[0].classes
        self.coefficients = np.mean([m.coefficients for m in members], axis=0)
        self.kind = "sigmoid"

    def scored(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        for i, m in enumerate(self.members):
            df = m.scored(df).withColumnRenamed("probability", f"_p{i}").drop("prediction")
        mean = F.array(*[sum((F.col(f"_p{i}")[k] for i in range(len(self.members))), F.lit(0.0)) / len(self.members) for k in range(len(self.classes))])
        df = df.withColumn("probability", mean)
        names = F.array(*[F.lit(c) for c in self.classes])
        return df.select(*kept, F.element_at(names, F.array_position("probability", F.array_max("probability")).cast("int")).alias("prediction"), "probability")


def members_of(model: Linear | Ensemble) -> list[Linear]:
    return model.members if isinstance(model, Ensemble) else [model]


@dataclass
class Trained:
    features: FeatureModel
    model: Linear | Ensemble
    name: str
    metrics: dict

    def save(self, path: str) -> None:
        """Features, coefficients (one row a class and member) and metrics under ``path``."""
        spark = SparkSession.active()
        self.features.save(f"{path}/features")
        rows = [
            (i, m.kind, k, c, m.coefficients[k].tolist(), float(m.intercepts[k]), m.platt[k].tolist() if m.platt is not None else None)
            for i, m in enumerate(members_of(self.model)) for k, c in enumerate(m.classes)
        ]
        spark.createDataFrame(rows, "member int, kind string, k int, label string, coefficients array<double>, intercept double, platt array<double>").write.mode("overwrite").parquet(f"{path}/model")
        spark.createDataFrame([(json.dumps({"name": self.name, "metrics": self.metrics}, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metrics")

    @staticmethod
    def load(path: str) -> "Trained":
        spark = SparkSession.active()
        held: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/model").collect():  # classes times members
            held.setdefault(r["member"], []).append(r)
        members = []
        for _, rows in sorted(held.items()):
            rows.sort(key=lambda r: r["k"])
            platt = np.array([r["platt"] for r in rows]) if rows[0]["platt"] is not None else None
            members.append(Linear([r["label"] for r in rows], np.array([r["coefficients"] for r in rows]), np.array([r["intercept"] for r in rows]), rows[0]["kind"], platt))
        said = json.loads(spark.read.text(f"{path}/metrics").first()["value"])
        return Trained(FeatureModel.load(f"{path}/features"), members[0] if members[0].kind != "sigmoid" else Ensemble(members), said["name"], said["metrics"])


class Served:
    """The model at a path, read again when it was written anew."""

    def __init__(self, path: str):
        self.path, self.stamp, self.trained = path, None, None

    def current(self) -> Trained:
        spark = SparkSession.active()
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/metrics/_SUCCESS")
        stamp = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()
        if stamp != self.stamp:
            self.trained, self.stamp = Trained.load(self.path), stamp
        return self.trained


def train_all(df: DataFrame, suffixes: Suffixes, seed: int = 42, kinds: tuple[str, ...] = ("logistic_regression", "linear_svm", "calibrated_linear_svm"), max_iter: int = 40) -> Trained:
    """Group split, augmentation, one featurisation for all models, reports, choice by adversarial macro-F1."""
    if df.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError("too few labelled rows")
    # generated or read once, however often the parts below are used
    df = settled(df.select("id", "text", "label", "template_id"), "corpus")
    df = df.withColumn("grp", F.coalesce(F.col("template_id"), F.concat(F.lit("row_"), F.col("id"))))
    split = group_split(df, "grp", {"train": 0.7, "val": 0.1, "test": 0.2}, seed)
    classes = sorted(r[0] for r in df.select("label").distinct().collect())
    train = augment(split.filter("part = 'train'"), "text", "id", "label", seed=seed)
    test = split.filter("part = 'test'")
    adversarial = obfuscate(test, "text", "id", seed).withColumn("text", F.col("obscured")).drop("obscured", "technique").withColumn("part", F.lit("adversarial"))
    every = train.unionByName(split.filter("part = 'val'")).unionByName(test).unionByName(adversarial)
    # the signals' plan is large: it is made and run once for all parts, and no fit or report below carries it
    base = settled(featurised(every, suffixes), "featurised")
    features = fit_features(base.filter("part = 'train'"))
    ready = settled(indexed(features.transform(base), classes).select("id", "part", "label", "features", "_y"), "vectors")
    fit_on = ready.filter("part = 'train'").persist()
    parts = {name: ready.filter(F.col("part") == name) for name in ("val", "test", "adversarial")}
    metrics: dict = {"headline_metric": "adversarial_macro_f1", "seed": seed, "models": {}}
    best = None
    for kind in kinds:
        model = {"logistic_regression": lambda: logistic(fit_on, classes, max_iter), "linear_svm": lambda: margins(fit_on, classes, max_iter), "calibrated_linear_svm": lambda: Ensemble(calibrated(fit_on, classes, "id", max_iter=max_iter))}[kind]()
        report = {name: {r["label"]: r.asDict() for r in classification_report(model.scored(d), "label", "prediction").collect()} for name, d in parts.items()}
        metrics["models"][kind] = {f"{name}_macro_f1": r["macro avg"]["f1"] for name, r in report.items()} | {"test_report": report["test"], "adversarial_report": report["adversarial"]}
        if model.kind != "margin" and (best is None or metrics["models"][kind]["adversarial_macro_f1"] > metrics["models"][best.name]["adversarial_macro_f1"]):
            best = Trained(features, model, kind, metrics)
    fit_on.unpersist()
    metrics["served_model"] = best.name
    return best
