"""Binary classifiers of overlaps from alignment features: split, class weights, a fit and its confusion table."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from spanloom.operators.histograms import bin_of


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """For each class its rows and the weight 1 / rows, by which both classes weigh the same."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).select(label, "n", (1.0 / F.col("n")).alias("weight"))


def feature_histograms(rows: DataFrame, ranges: dict[str, tuple[float, float]], n_bins: int, label: str = "label") -> DataFrame:
    """Counts by feature, class and bin; all features in one pass."""
    cells = [F.struct(F.lit(f).alias("feature"), bin_of(F.col(f), a, b, n_bins).cast("long").alias("bin")) for f, (a, b) in ranges.items()]
    return rows.select(label, F.explode(F.array(*cells)).alias("c")).filter("c.bin is not null").groupBy("c.feature", label, "c.bin").agg(F.count("*").alias("n"))


def split(rows: DataFrame, key: str, share: float = 0.6, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: the same on every run and however rows are partitioned."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000))
    return rows.filter(part < int(1000 * share)), rows.filter(part >= int(1000 * share))


def confusion_of_fit(rows: DataFrame, key: str, features: list[str], label: str = "label") -> DataFrame:
    """actual, predicted, n on the test rows, of a class-balanced logistic regression over scaled features."""
    weighted = rows.join(F.broadcast(class_weights(rows, label).select(label, "weight")), label)  # two rows
    train, test = split(weighted, key)
    assembled = VectorAssembler(inputCols=features, outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembled.transform(train))
    prepare = lambda df: scaler.transform(assembled.transform(df))
    model = LogisticRegression(labelCol=label, weightCol="weight", maxIter=25, regParam=1e-4).fit(prepare(train))
    return model.transform(prepare(test)).groupBy(F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
