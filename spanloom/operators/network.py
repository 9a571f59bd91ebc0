"""A layered network on balanced samples, in place of one that needs a deep-learning library."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from spanloom.functions.scratch import stored
from spanloom.operators.learning import split

#: Hidden layers, the steps of the fit, and the number of training rows that it takes at most (a hashed sample).
HIDDEN, STEPS, SAMPLE = (128, 256, 128), 25, 10_000
#: Rows that go through the layers together: as many bound the memory of a task, and fit a core's cache.
BLOCK = 256


def poisson_table(rate: float) -> list[float]:
    """Probabilities of at most 0, 1, 2... for a Poisson variable, as far as they can be told from 1."""
    term, total, out = math.exp(-rate), 0.0, []
    for k in range(1, int(rate + 12 * math.sqrt(rate) + 20)):
        total += term
        out.append(min(total, 1.0))
        term *= rate / k
    return out


def balanced(rows: DataFrame, key: str, label: str = "label", size: int | None = None, seed: int = 1, most: float = 200.0) -> DataFrame:
    """A sample with replacement in which every class has about the same number of rows, ``size`` in all (as many as rows, if None).

    A row is repeated by a Poisson count, whose rate is the class's share of the sample over
    its rows, drawn from a hash of ``key``: the same on every run and however rows lie. Two
    rows of one key get the same count, so ``key`` should tell rows apart. No row meets
    another, so nothing is shuffled. A rate beyond ``most`` is met by equal repeats.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    whole = size or sum(counts.values())
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    times = F.lit(0)
    for value, n in counts.items():
        rate = whole / len(counts) / n
        equal, part = divmod(rate, most) if rate > most else (0, rate)
        drawn = int(equal * most) + F.size(F.filter(F.array(*map(F.lit, poisson_table(part))), lambda p: p < u))
        times = F.when(F.col(label) == value, drawn).otherwise(times)
    return rows.withColumn("_times", times).filter("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_time")


def outputs(x: np.ndarray, layers: list[int], weights: np.ndarray) -> np.ndarray:
    """What the last layer gives for each row of ``x`` before the softmax; ``weights`` as Spark's perceptron has them: each layer's matrix by columns, then its offsets."""
    at = 0
    for k, (into, out) in enumerate(zip(layers[:-1], layers[1:])):
        matrix, offsets = weights[at : at + into * out].reshape(into, out), weights[at + into * out : at + into * out + out]
        at += into * out + out
        if k:
            np.negative(x, out=x)
            with np.errstate(over="ignore"):
                np.exp(x, out=x)
            x += 1.0
            np.reciprocal(x, out=x)
        x = x @ matrix
        x += offsets
    return x


def scored_rows(rows: DataFrame, features: list[str], shift: np.ndarray, scale: np.ndarray, layers: list[int], weights: np.ndarray) -> DataFrame:
    """``rows`` with rawPrediction, probability and prediction of a network of two classes, as ``MultilayerPerceptronClassificationModel.transform`` finds them.

    Rows go through the layers by blocks and once: the result is stored. A feature that is null or NaN is an error, as it is for ``VectorAssembler``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch.to_numpy(np.float64)
            if np.isnan(x).any():
                raise ValueError("a feature is null or NaN")
            x = (x - shift) * scale
            out = [outputs(x[k : k + BLOCK], layers, weights) for k in range(0, len(x), BLOCK)]
            yield pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2)), columns=["raw0", "raw1"])

    score = F.pandas_udf(run, "raw0 double, raw1 double")
    ended = stored(rows.withColumn("_raw", score(F.struct(*[F.col(c).cast("double") for c in features]))), "scored")
    raw = [F.col("_raw.raw0"), F.col("_raw.raw1")]
    power = [F.exp(r - F.greatest(*raw)) for r in raw]
    share = [p / (power[0] + power[1]) for p in power]
    added = {"rawPrediction": array_to_vector(F.array(*raw)), "probability": array_to_vector(F.array(*share)), "prediction": (share[1] > share[0]).cast("double")}
    return ended.withColumns(added).drop("_raw")


def network_fit(rows: DataFrame, key: str, features: list[str], label: str = "label", hidden: tuple[int, ...] = HIDDEN, steps: int = STEPS, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """(the whole test split with prediction and probability, its area under the ROC curve) of a network fitted on a balanced sample.

    Features are scaled by the training split's means and deviations. The sample takes
    about ``sample`` rows of the training split; the test split is neither sampled nor balanced.
    """
    train, test = split(rows, key)
    n = train.count()
    share = min(1.0, 2.0 * sample / max(n, 1))
    chosen = train.filter(F.pmod(F.xxhash64(F.lit("network"), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))
    fitted = stored(balanced(chosen, key, label, min(sample, n)), "network-sample")
    assembler = VectorAssembler(inputCols=features, outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembler.transform(train))
    model = MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), *hidden, 2], maxIter=steps, seed=1).fit(scaler.transform(assembler.transform(fitted)))
    std = scaler.std.toArray()
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
    scored = scored_rows(test, features, scaler.mean.toArray(), scale, [len(features), *hidden, 2], model.weights.toArray())
    # all points of the curve: with Spark's 1,000 bins the area changes with how rows lie in partitions
    area = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", numBins=0).evaluate(scored)
    return scored, area
