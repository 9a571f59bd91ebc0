"""Operator 4, quality rules: decision lists learned by sequential covering. DataFrame functions only.

``statistics`` computes counts and ratios of every whole text. ``learn`` grows
rules on labelled rows: each step asks Spark for the label counts by feature and
bin (features x bins rows at most, whatever the input), adds the threshold of
highest gain to the conjunction, prunes the rule on rows kept apart for it, and
takes the covered rows away. ``verdict`` turns the ordered rules into one
conditional expression.

Defined results. Null text counts as empty: no words, all counts 0, base_failed
true, kept false. Null or repeated doc_id: each row is judged by itself; such
rows may carry labels like any other. Empty tables give empty results. Without
labels of both kinds no rule is learned and only the base rule rejects. A text of any
length is counted whole, in the task that reads it. Columns
other than ``id`` and ``text`` are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.llm.common import documents, fold, let, stored, text_or_empty, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "upper_share", "bang_share", "bar_share", "repeat_share", "dup_line_share", "mean_word", "distinct_share"]
WINDOW = 5


def repeated_words(w: Column) -> Column:
    """Words of the array ``w`` that stand in a 5-word window found at least twice.

    Hashes of the windows show first whether any can be repeated; only texts in
    which two hashes agree sort the windows themselves, so the count is exact.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(by_text: Column) -> Column:
        last = F.size(by_text) - 1
        places = F.array_compact(
            F.transform(
                by_text,
                lambda x, k: F.when(
                    ((k > 0) & (x["w"] == F.get(by_text, k - 1)["w"])) | ((k < last) & (x["w"] == F.get(by_text, k + 1)["w"])), x["p"]
                ),
            )
        )
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n"))
        return F.aggregate(F.sort_array(places), start, step, lambda acc: acc["n"])

    def windows(h: Column) -> Column:
        by_text = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("w"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(by_text, covered))

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(hashes, windows))


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, the five base counts (long) and the ratios in FEATURES (double, 0 for empty texts) of each row."""
    t = text_or_empty(F.col(text))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
            repeated_words(w).alias("n_repeat_words"),
        )

    marks = F.regexp_replace(t, r"[^#*$%&|<>!]+", "")
    counted = docs.select(
        F.col(id).alias("doc_id"),
        let(words(F.col(text)), of_words).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        let(marks, lambda x: F.struct(F.length(F.replace(x, F.lit("!"), F.lit(""))).alias("symbols"), F.length(x).alias("all"), F.length(F.regexp_replace(x, r"[^|]+", "")).alias("bars"))).alias("m"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("upper"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, chars = F.col("w.n_words"), F.col("w.word_chars")
    return counted.select(
        "doc_id",
        *[c.cast("long").alias(k) for k, c in zip(COUNTS, [n, chars, F.col("m.symbols"), F.col("l.dup"), F.col("w.n_repeat_words")])],
        share(F.col("m.symbols"), chars).alias("symbol_share"),
        share(F.col("upper"), chars).alias("upper_share"),
        share(F.col("m.all") - F.col("m.symbols"), n).alias("bang_share"),
        share(F.col("m.bars"), n).alias("bar_share"),
        share(F.col("w.n_repeat_words"), n).alias("repeat_share"),
        share(F.col("l.dup"), F.col("l.n")).alias("dup_line_share"),
        share(chars, n).alias("mean_word"),
        share(F.col("w.n_distinct"), n).alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature > cut`` or, if not above, ``feature <= cut``."""

    feature: str
    cut: float
    above: bool

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional: the number (from 1) of the first rule that holds, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
    return F.lit(0) if out is None else out.otherwise(0)


def _bins(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """``rows`` with ``_bins``: for each feature its name and the number of cuts below its value."""
    below = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c < F.col(f)))
    return rows.withColumn("_bins", F.array(*[F.struct(F.lit(f).alias("f"), below(f).alias("b")) for f in cuts]))


def _histogram(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """Bad and good rows by feature and bin: at most features x (cuts + 1) rows reach the driver."""
    got = rows.select("bad", F.explode("_bins").alias("c")).groupBy("c.f", "c.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    return {(r["f"], r["b"]): (r["p"], r["n"]) for r in got.collect()}


def _best(hist: dict, cuts: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition | None, int, int]:
    """The condition of highest FOIL gain, with the rows it leaves; of cuts that leave the same rows, the middle one."""
    if not p0:
        return 0.0, None, 0, 0
    base = math.log2(p0 / (p0 + n0))
    found: dict[tuple, list[float]] = {}
    for f, cs in cuts.items():
        for k, cut in enumerate(cs):
            up = [sum(v[i] for (g, b), v in hist.items() if g == f and b > k) for i in (0, 1)]
            for above, (p, n) in ((True, up), (False, (p0 - up[0], n0 - up[1]))):
                if p and (gain := p * (math.log2(p / (p + n)) - base)) > 1e-9:
                    found.setdefault((round(gain, 9), f, above, p, n), []).append(cut)
    if not found:
        return 0.0, None, 0, 0
    gain, f, above, p, n = best = max(found)
    return gain, Condition(f, found[best][len(found[best]) // 2], above), p, n


def learn(labelled: DataFrame, features: list[str] = FEATURES, bins: int = 12, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.9, min_cover: float = 0.004) -> list[Rule]:
    """Sequential covering over all labelled rows: columns ``bad`` (0/1), ``grow`` (boolean) and the features.

    A rule is grown while its precision on the growing rows is under 0.995 and
    then loses its last conditions as long as that raises (p - n) / (p + n) on the
    pruning rows. A rule that covers fewer than ``min_cover`` of the bad rows, or
    that is right on fewer than ``min_precision`` of the pruning rows it covers,
    ends the list: clean documents stay.
    """
    marks = [k / bins for k in range(bins + 1)]
    both = labelled.select(*[F.percentile_approx(f, marks, 2000).alias(f) for f in features], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), marks, 2000).alias(f"{f}_bad") for f in features], F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).first()
    if not both["p"] or not both["n"]:
        return []
    seen = {f: sorted({float(x) for x in (both[f] or []) + (both[f"{f}_bad"] or []) if x is not None and math.isfinite(x)}) for f in features}
    cuts = {f: sorted(set(xs) | {a + (b - a) * part for a, b in zip(xs, xs[1:]) for part in (0.25, 0.5, 0.75)}) for f, xs in seen.items()}
    labelled = stored(_bins(labelled, cuts), "labelled")
    rules: list[Rule] = []
    least = max(3.0, min_cover * both["p"])
    while len(rules) < max_rules:
        left = labelled.filter(verdict(rules) == 0)
        grown: list[Condition] = []
        while len(grown) < max_conditions:
            rows = left.filter(F.col("grow") & Rule(tuple(grown)).column())
            hist = _histogram(rows)
            p0, n0 = (sum(v[i] for (f, _), v in hist.items() if f == next(iter(cuts))) for i in (0, 1))
            gain, condition, p, n = _best(hist, cuts, p0, n0)
            if condition is None:
                break
            grown.append(condition)
            if p >= 0.995 * (p + n):
                break
        if not grown:
            break
        prefixes = [Rule(tuple(grown[:k])).column() for k in range(1, len(grown) + 1)]
        tried = left.filter(~F.col("grow")).agg(*[F.sum(F.when(c, v).otherwise(0)).alias(f"{x}{k}") for k, c in enumerate(prefixes) for x, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        counts = [(tried[f"p{k}"] or 0, tried[f"n{k}"] or 0) for k in range(len(prefixes))]
        worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(counts)]
        keep = -max(worth)[1]
        p, n = counts[keep]
        if p < least / 3 or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple(grown[: keep + 1])))
    return rules


def learn_from(stats: DataFrame, labels: DataFrame, id: str = "doc_id", quality: str = "quality") -> list[Rule]:
    """Rules for the documents that the base rule leaves, from stored statistics and their labels.

    Two thirds of the labelled rows grow rules and one third prunes them, by the id's checksum.
    """
    marked = labels.select(F.col(id).alias("doc_id"), F.col(quality).alias("label")).filter(F.col("label").isin(0, 1))
    left = stats.filter(~base_failed()).select("doc_id", *FEATURES)
    rows = left.join(marked, "doc_id").select((1 - F.col("label")).cast("long").alias("bad"), (fold(F.col("doc_id"), 3) != 0).alias("grow"), *FEATURES)
    return learn(stored(rows, "labels"))


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """Statistics, ``base_failed``, ``rule`` and ``kept`` of every document, and the rules learned from ``labels``."""
    stats = stored(statistics(docs, id, text), "statistics")
    rules = learn_from(stats, labels, id, quality)
    out = stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def keep(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    The rows are stored beside their statistics, so texts are read once and not shuffled.
    """
    names = {c: f"_doc_{k}" for k, c in enumerate(docs.columns)}
    row = F.struct(*[F.col(c).alias(n) for c, n in names.items()])
    told = stored(statistics(docs.select(row.alias("_row"), F.col(text).alias("_text")), "_row", "_text").withColumnRenamed("doc_id", "_row"), "statistics")
    rules = learn_from(told.withColumn("doc_id", F.col(f"_row.{names[id]}")), labels, id, quality)
    kept = told.filter(~base_failed() & (verdict(rules) == 0))
    return kept.select(*[F.col(f"_row.{n}").alias(c) for c, n in names.items()])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "rule")
