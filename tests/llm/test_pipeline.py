"""The pipeline's stages on the smallest tables, each held against what it was given."""

import collections
import hashlib

import brute
import corpus_pipeline
from spanloom.functions import scratch
from spanloom.llm import bpe, neardup, quality_rules, secrets
from spanloom.llm.common import documents, stored


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns, given = docs.columns, {r.doc_id: r for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        after[name[0]] = docs.collect()
        if name[0] != "6":
            assert docs.columns == columns
    assert {r.doc_id for r in after["4"]} < set(given) and all(r == given[r.doc_id] for r in after["4"])
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in after["4"]}
    assert sum(label.get(i) == 1 and len(given[i].text.split()) >= 10 for i in given) - sum(label.get(i) == 1 for i in kept) <= 2
    classes = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(after["4"], docs.sparkSession.read.parquet(f"{sf}/documents.parquet").schema)).collect()}
    assert sorted(r.doc_id for r in after["1"]) == sorted(set(classes.values()))
    assert len(after["2"]) == len(after["1"])
    assert not any(secrets.spans(rule, r.text) for r in after["2"] for rule in secrets.RULES if rule.base)
    copies = collections.Counter(r.doc_id for r in after["7"])
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in after["2"]}
    assert len(after["6"]) == len(after["7"]) and all(r.n_tokens == len(r.ids) for r in after["6"])


def test_run_equals_a_plain_version(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, rules = quality_rules.judge(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    given = {r.doc_id: r for r in docs.collect()}
    kept = {i: r.text for i, r in given.items() if brute.passes(r.text, rules)}
    least = brute.near_classes(kept)
    clean = {i: brute.redacted(t) for i, t in kept.items() if least[i] == i}
    library, want = Tokenizer.from_file(bpe.VOCABULARY), collections.Counter()
    for (i, _, text), ((_, copies),) in brute.dealt([(i, t, given[i].source) for i, t in clean.items()]).items():
        ids = library.encode(text, add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[i, len(ids), digest(",".join(map(str, ids))), digest(text)] += copies
    before = len(scratch.written())
    got = corpus_pipeline.run(spark, sf)
    assert len(scratch.written()) == before + 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == +want


def test_odd_rows_go_through(spark, sf):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "y"), (None, text + " and more words that differ from it in the end", None, None, None, "z"), (2, None, "en", "a", 0, None), (3, "", "en", "b", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            now = stored(stage(spark, now, sf), "stage")
            assert name[0] == "6" or now.columns == docs.columns
        assert now.count() == 0 if empty else {r.doc_id for r in now.collect()} <= {1, None}


def test_registered():
    assert set(corpus_pipeline.QUERIES) == {"pipeline"} and corpus_pipeline.ORACLE_SQL is None


def test_stages_may_be_called_lazily_and_in_any_number(spark, sf):
    docs = corpus_pipeline.documents(spark, sf)
    one, two = corpus_pipeline.quality(spark, docs, sf), corpus_pipeline.quality(spark, docs.filter("lang = 'en'"), sf)
    n = one.count()
    assert 0 < two.count() < n
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, sf), sf)
    again = corpus_pipeline.near_duplicates(spark, one, sf)
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(r.doc_id for r in again.collect()) and len(ids) < n
    clean = corpus_pipeline.secret_scan(spark, kept, sf)
    mixed = corpus_pipeline.mixture(spark, clean, sf)
    coded = corpus_pipeline.encoded(spark, mixed, sf)
    assert coded.count() == mixed.count() and one.count() == n and clean.count() == len(ids)
