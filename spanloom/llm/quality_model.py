"""Operator 3, quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
the sum-of-squares identity makes all pairwise interactions linear in the entries
of x. Spark's factorisation machine fits it by gradient sums over partitions and
applies it in the JVM.

x holds the hashed words of the whole text (their counts, scaled to unit length), one
indicator for the bin of each structure statistic, and one for the bin of the
table's own character count. Labels, lang, source and ids are no inputs. The model
is fitted on at most SAMPLE labelled rows whose fold is not 0, picked by a hash of
the id; that bound is what allows their ids to be broadcast.

Defined results. Null text counts as empty and is scored like any text. Null ids
fall into fold 0 and are never learned from. Repeated labels of an id count once,
by their lowest value. Without training labels of both kinds the score is the share
of label 1 among them, or 0.5. A text of any length is counted whole. Empty tables
give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.llm.common import documents, fold, let, stored, text_or_empty, words

SAMPLE, HASHED, FACTORS, ROUNDS, THRESHOLD = 16_000, 4096, 4, 60, 0.3
#: Upper ends of the bins of each statistic.
BINS = {
    "symbols": [0.0, 0.01, 0.03, 0.06, 0.1, 0.2],
    "upper": [0.01, 0.03, 0.06, 0.12, 0.3, 0.6],
    "bangs": [0.0, 0.02, 0.1, 0.3, 0.6],
    "digits": [0.0, 0.005, 0.02, 0.06, 0.15],
    "distinct": [0.05, 0.12, 0.25, 0.4, 0.55, 0.7, 0.85],
    "word_length": [2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 11.0],
    "log_words": [1.0, 2.3, 3.5, 4.5, 5.5, 6.5, 7.5, 9.0],
    "line_words": [2.0, 5.0, 10.0, 20.0, 50.0, 150.0],
    "log_chars": [2.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0],
}


def statistics(text: Column, w: Column, n_chars: Column) -> dict[str, Column]:
    """Ratios of the whole text; ``w`` are its words, ``n_chars`` the table's character count (null: -1)."""
    t = text_or_empty(text)
    kept = lambda keep: F.length(F.regexp_replace(t, rf"[^{keep}]+", "")).cast("double")
    n = F.size(w).cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    chars = F.length(t).cast("double")
    return {
        "symbols": share(kept("#*$%&|<>"), chars),
        "upper": share(kept(r"\p{Lu}"), chars),
        "bangs": share(kept("!"), n),
        "digits": share(kept("0-9"), chars),
        "distinct": share(F.size(F.array_distinct(w)).cast("double"), n),
        "word_length": share(chars, n),
        "log_words": F.log1p(n),
        "line_words": share(n, 1 + kept(r"\n")),
        "log_chars": F.coalesce(F.log1p(F.greatest(n_chars.cast("double"), F.lit(0.0))), F.lit(-1.0)),
    }


def indicators(stats: Column) -> Column:
    """One 1.0 for each statistic, at its bin."""
    flags = []
    for name, ends in BINS.items():
        low = [F.lit(True), *[stats[name] > e for e in ends]]
        high = [*[stats[name] <= e for e in ends], F.lit(True)]
        flags += [F.when(a & b, 1.0).otherwise(0.0) for a, b in zip(low, high)]
    return F.array(*flags)


def vectors(docs: DataFrame, id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """doc_id, held_out and the vector x of each row."""
    hashed = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=HASHED)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    whole = VectorAssembler(inputCols=["_unit", "_structure"], outputCol="x")
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text"), F.col(n_chars).alias("_n_chars"))
    rows = rows.select("doc_id", "_text", "_n_chars", words(F.col("_text")).alias("_words"))
    stats = let(F.col("_words"), lambda w: F.struct(*[c.alias(k) for k, c in statistics(F.col("_text"), w, F.col("_n_chars")).items()]))
    rows = rows.select("doc_id", "_words", stats.alias("_stats"))
    rows = rows.select("doc_id", "_words", array_to_vector(indicators(F.col("_stats"))).alias("_structure"))
    # with the size given, the assembler needs no look at the first row
    sized = VectorSizeHint(inputCol="_structure", size=sum(len(ends) + 1 for ends in BINS.values()), handleInvalid="optimistic")
    rows = sized.transform(rows)
    out = whole.transform(unit.transform(hashed.transform(rows)))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "x")


def training_ids(labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """At most about ``sample`` labelled ids outside fold 0, by hash, with their label."""
    rows = labels.filter(F.col(quality).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("doc_id")).agg(F.min(quality).cast("double").alias("label"))
    rows = stored(rows.filter(fold(F.col("doc_id")) != 0), "labels")
    n = rows.count()
    if n <= sample:
        return rows
    part = F.xxhash64(F.col("doc_id"), F.lit(3)).cast("double") / F.lit(2.0**64) + 0.5
    return rows.filter(part < 0.97 * sample / n).orderBy("doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **names):
    """The fitted machine, or the constant score if the training labels are not of both kinds."""
    ids = training_ids(labels, sample)
    train = stored(vectors(docs.join(F.broadcast(ids.select(F.col("doc_id").alias(names.get("id", "doc_id")))), names.get("id", "doc_id"), "left_semi"), **names).join(F.broadcast(ids), "doc_id"), "training")
    counts = train.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not counts["n"] or counts["ones"] in (0, counts["n"]):
        return counts["ones"] / counts["n"] if counts["n"] else 0.5
    machine = FMClassifier(featuresCol="x", labelCol="label", factorSize=FACTORS, maxIter=ROUNDS, stepSize=0.1, regParam=1e-5, initStd=0.01, seed=5)
    return machine.fit(train.select("x", "label").coalesce(12))


def score(docs: DataFrame, model, **names) -> DataFrame:
    """doc_id, held_out and score of each row."""
    rows = vectors(docs, **names)
    if isinstance(model, float):
        return rows.select("doc_id", "held_out", F.lit(model).alias("score"))
    return model.transform(rows).select("doc_id", "held_out", vector_to_array("probability")[1].alias("score"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
