"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, encoding, each over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read back as the next stage's docs. All but the last
return the columns of ``documents``. Stages may be called in any order and number, and
their results used at any time: a stage deletes only tables of its own, once its result
is written.

Defined results. Null, empty and blank texts go in the first stage, which keeps no text
of fewer than ten words. Of rows equal in id and class the second stage keeps one; null
ids come last there, and are told apart by their text. Null sources are one source of
the mixture. Texts of any length go through whole. Extra columns are carried along by
all stages but the last, whatever their names. Empty tables, labels included, give
empty results.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, mixing, neardup, quality_rules, secrets
from spanloom.llm.common import documents, drop_stored, stored, written


def _stage(f):
    """A stage whose result is written before the tables that it was made from are deleted; nothing else is.

    It is for stages whose tables take more room than their result.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = set(written())
        out = stored(f(spark, docs, sf_dir), f.__name__)
        drop_stored(spark, [t for t in written() if t not in others][:-1])
        return out

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id."""
    return neardup.keep_one(docs)


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars counted anew where that changed a text."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it as a whole."""
    return mixing.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and checksums of the ids and of the text decoded from them."""
    return bpe.encode(docs)


STAGES = [
    ("4 quality rules", quality),
    ("1 n-gram Jaccard join", near_duplicates),
    ("2 secret scans", secret_scan),
    ("7 mixing", mixture),
    ("6 BPE encoding", encoded),
]
#: The learned rules, the sketch join and the merges have no SQL form; a test holds run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written is deleted as soon as the next stage's output is."""
    docs, others = documents(spark, sf_dir), set(written())
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
        drop_stored(spark, [t for t in written() if t not in others][:-1])
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL}
