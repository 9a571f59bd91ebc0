"""Operator 11, spelling variants by PartEnum signatures.

A word's letters are a binary vector: one place for each letter and each of its
occurrences. One inserted, deleted or replaced letter changes at most two places, so
near words have a Hamming distance of at most two. PartEnum deals the letters of the
alphabet into PARTS parts; of two words at distance two at most two parts differ, so
they agree in all others. Each way of leaving two parts out gives a signature, the
letters in the parts that stay. Near words share at least one; words that share one are
joined by it and verified.

Words of one signature are compared in the task that reads them, through their forms
with one letter masked or left out, which takes time in proportion to the words, not
their pairs. A pair is emitted by one signature only, the first that leaves out the
parts in which its two letters lie. A signature with more than GROUP words is dealt out
anew by the words' forms with one letter left out, of which two near words share at
least one, so that no task is given a group that grows with the vocabulary.

Words and counts are summed before they are shuffled, so a word that makes up a third
of the text is no large group. Roots are found by doubling: each round a word looks up
the root of its root; with counts at least doubling along the forms, six rounds are
enough for any count of 64 bits.

Defined results. Null text has no words; a null id is an empty string before the colon.
Null or repeated ids and repeated rows are rows of their own, whose occurrences add up.
A text of any length is read whole. Ties between forms go to the least word in order of
code points. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.llm.common import documents, let, small_side, stored, text_or_empty
from spanloom.llm.lookups import lookup

LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
PARTS, AWAY = 4, 2
#: Words of one signature that are compared in one group.
GROUP = 5000
#: The alphabet, most frequent letters first, so that dealing them out in turn gives parts of like weight.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz" + "".join(map(chr, range(0xC0, 0x100)))
PART = {c: k % PARTS for k, c in enumerate(LETTERS)}
#: The parts that a signature leaves out, for each signature.
LEFT_OUT = list(combinations(range(PARTS), AWAY))


def words(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """word and n for each word of at least LEAST_LENGTH letters and ``least`` occurrences, after every EVERY-th lost a letter."""
    lower = F.translate(text_or_empty(F.col(text)), string.ascii_uppercase, string.ascii_lowercase)
    runs = F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % EVERY == 0, shorter).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= least) & (F.length("word") >= LEAST_LENGTH))


def signatures(word: Column) -> Column:
    """An array with a hash for each signature of a word."""
    of_part = lambda k: F.array_sort(F.split(F.translate(word, "".join(c for c in LETTERS if PART[c] != k), ""), ""))
    own = let(F.array(*map(of_part, range(PARTS))), lambda parts: F.array(*[F.xxhash64(F.lit(k), *[F.array_join(parts[p], "") for p in range(PARTS) if p not in out]) for k, out in enumerate(LEFT_OUT)]))
    return own


def one_letter_out(word: Column) -> Column:
    """The word and its forms with one letter left out, each once."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))))


def owner(*letters: str) -> int:
    """The first signature that leaves out the parts of these letters."""
    parts = {PART[c] for c in letters}
    return next(k for k, out in enumerate(LEFT_OUT) if parts <= set(out))


def near_in(group: list[tuple[str, int]], which: int, form: str | None) -> Iterator[tuple[str, int, str, int]]:
    """Pairs (word, n, word, n) of the group's words that differ by one letter and belong to signature ``which`` (and to ``form``, if given)."""
    masked, counts = defaultdict(list), dict(group)
    for w, n in group:
        for i in range(len(w)):
            masked[w[:i] + "*" + w[i + 1 :]].append(w)
    for mask, same in masked.items():
        if len(same) > 1:
            i = mask.index("*")
            if form is None or mask[:i] + mask[i + 1 :] == form:
                for a, b in combinations(same, 2):
                    if owner(a[i], b[i]) == which:
                        yield a, counts[a], b, counts[b]
    for w, n in group:
        for i in range(len(w)):
            # of equal letters in a row only the first is left out
            if i and w[i] == w[i - 1]:
                continue
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts and (form is None or shorter == form) and owner(w[i]) == which:
                yield w, n, shorter, counts[shorter]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key (key, which, form, word, n) become both directions of each near pair (word, other, n)."""
    group: list[tuple[str, int]] = []
    now = None

    def flush(out: list) -> None:
        if len(group) > 1:
            for a, na, b, nb in near_in(group, now[1], now[2]):
                out += [(a, b, nb), (b, a, na)]

    def made(out: list) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "other", "n"])

    for batch in batches:
        out: list = []
        for key, which, form, w, n in zip(*(batch.column(c).to_pylist() for c in ("key", "which", "form", "word", "n"))):
            if now is None or key != now[0] or form != now[2] or which != now[1]:
                flush(out)
                group, now = [], (key, which, form)
            group.append((w, n))
        if out:
            yield made(out)
    out = []
    flush(out)
    if out:
        yield made(out)


def near_pairs(counted: DataFrame, group: int = GROUP) -> DataFrame:
    """word, other, n (of the other) for each ordered pair of near words of stored ``counted`` (word, n)."""
    keyed = counted.select("word", "n", F.posexplode(signatures(F.col("word"))).alias("which", "key"))
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > group).select("key"), "spelling-hot")
    cold, rows = keyed.withColumn("form", F.lit(None).cast("string")), ["key", "which", "form", "word", "n"]
    if hot.limit(1).count():
        few = small_side(hot)
        cold = cold.join(few, "key", "left_anti")
        forms = keyed.join(few, "key").withColumn("form", F.explode(one_letter_out(F.col("word"))))
        cold = cold.select(*rows).unionByName(forms.withColumn("key", F.xxhash64("key", "form")).select(*rows))
    dealt = cold.select(*rows).repartition("key").sortWithinPartitions("key", "which", "form")
    return dealt.mapInArrow(_verified, "word string, other string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of stored ``forms`` (word, form): the last word that following the forms leads to."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = stored(now, "spelling-roots")
        # a root that is a word with a form is not the last; counted are the rows that look it up
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        table = stored(now.groupBy("root").agg(F.count("*").alias("_n")).join(up, "root"), "spelling-next")
        if not table.limit(1).count():
            return now
        now = lookup(now, table, "root", "_n").select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each word, see ``op11_spelling_variants``."""
    counted = stored(words(docs, id, text), "spelling-words")
    best = near_pairs(counted, group).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    joined = counted.join(best, "word", "left").withColumn("_form", -F.col("best.n") >= 2 * F.col("n"))
    near = joined.select("word", F.when(F.col("_form"), F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_form"), -F.col("best.n")).alias("form_n"))
    near = stored(near, "spelling-near")
    last = roots(near.filter(F.col("form").isNotNull()))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


OP11_SQL = f"""
WITH run AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-zÀ-ÿ]+')) AS run FROM documents
), own AS (
  SELECT run, coalesce(doc, '') || ':' || run AS s, count(*) AS n FROM run WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1] FOR i IN range(octet_length(encode(s)))])),
    lambda r, b: xor(xor(r, greatest(b, 0)) >> 1, CASE WHEN (xor(r, greatest(b, 0)) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h
  FROM own
), word AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1
), w AS (
  SELECT word, n FROM word WHERE n >= {LEAST_COUNT} AND length(word) >= {LEAST_LENGTH}
), k AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS form FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), pair AS (
  SELECT a.word, b.word AS other, b.n AS n FROM k AS a JOIN k AS b ON a.form = b.form AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.form = w.word
  UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.form = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM pair GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN other END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN best ON w.word = best.word
), way AS (
  WITH RECURSIVE r AS (
    SELECT word, word AS root FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL
  ) SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN way ON f.word = way.word
"""
