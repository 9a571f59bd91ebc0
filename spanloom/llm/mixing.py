"""Operator 7, mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w, with u from a hash of seed, id and text and w its
quality weight; the smallest keys come first. Each source's target is met with
complete epochs first; the rest of its budget is filled along the keys by a
prefix sum of sizes, and the document on the boundary gives the words that are
left.

The boundary is all that a row must know: what comes before it in the order of the
keys is taken whole. Sizes are summed by cells of a grid over the keys, running sums
over the cells find the one in which the budget ends, and only that cell's rows are
sorted, in buckets of even size whose borders come from counts of the keys. Rows
equal in all that orders them count as one there, with their number. So no source is
sorted in one task, whatever its size, weights or copies, and rows get their share by
comparison with the table of boundaries, not by a shuffle.

Targets share the total size by weight, capped at ``most`` times a source's size.
The excess goes to the others by weight until none is above: sorted by cap over
weight, the capped sources are a prefix, which running sums over the table of
sources find at once.

Defined results. Null text has size 0 and is never taken; a text of any length is
counted whole. Null sources form one source, placed last. Null or repeated ids and
repeated rows are separate rows; rows equal in id, text and source are
interchangeable. Empty tables give empty results. Other columns are ignored by
``mix`` and carried along by ``emit``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanloom.llm.common import documents, let, small_side, stored, text_or_empty, words
from spanloom.llm.lookups import attach
from spanloom.llm.ranks import ROWS_A_BUCKET, buckets_for, running, sorted_running

SEED, MOST, CYCLE = "mix-1", 3, (1, 2, 3)
#: Grid cells of the natural logarithm of the keys: some 2,700 a source cover all keys there are.
GRID = 64


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the product of what is left of 1 after symbols (four times their share), capitals and repeated lines."""
    t = text_or_empty(text)
    kept = lambda letters: F.length(F.regexp_replace(t, letters, "")).cast("double")
    n = F.greatest(F.lit(1), F.length(t)).cast("double")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    fresh = let(lines, lambda x: F.size(F.array_distinct(x)).cast("double") / F.greatest(F.lit(1), F.size(x)).cast("double"))
    return F.greatest(F.lit(0.1), (1 - 4 * kept(r"[^#*$%&|<>]+") / n) * (1 - kept(r"[^\p{Lu}]+") / n) * fresh)


def sources(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: float = MOST) -> DataFrame:
    """One row for each source: its number in code-point order (null last), rows, size, weight and target."""
    table = stored(sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "mix-sizes")
    total = table.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    table = sorted_running(table, [F.col("source").asc_nulls_last()], {"sid": F.lit(1)})
    table = table.withColumn("w", F.element_at(F.array(*map(F.lit, cycle)), (F.col("sid") % len(cycle) + 1).cast("int")).cast("double"))
    table = table.withColumn("cap", most * F.col("source_size").cast("double"))
    weights = stored(table, "mix-weights")
    w_all = weights.agg(F.sum("w")).first()[0] or 0.0
    order = [F.col("cap") / F.col("w"), F.col("sid")]
    table = sorted_running(weights, order, {"_at": F.lit(1), "_caps": F.col("cap"), "_ws": F.col("w")})
    # the level at which this source and those after it would share what the capped ones before leave
    table = stored(table.withColumn("level", (F.lit(total) - F.col("_caps")) / (F.lit(w_all) - F.col("_ws"))), "mix-levels")
    level = table.filter(F.col("cap") >= F.col("level") * F.col("w")).agg(F.min_by("level", "_at")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return table.select("source", "sid", "n", "source_size", F.round(target, 6).alias("target"))


def bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (sid, _key and others; stored) with _bucket: buckets of about ROWS_A_BUCKET in the order of the keys of a source.

    A row's place is the number of rows in the grid cells before its own plus its
    cell's rows in proportion to where it lies in the cell. With the key, it never falls.
    """
    at = F.log("_key") * GRID
    cells = rows.groupBy("sid", F.floor(at).alias("_cell")).agg(F.count("*").alias("_in_cell"))
    before = Window.partitionBy("sid").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    grid = stored(cells.withColumn("_cells_before", F.coalesce(F.sum("_in_cell").over(before), F.lit(0))), "mix-grid")
    place = F.col("_cells_before") + (at - F.col("_cell")) * F.col("_in_cell")
    joined = rows.withColumn("_cell", F.floor(at)).join(small_side(grid), ["sid", "_cell"])
    return joined.withColumn("_bucket", F.floor(place / ROWS_A_BUCKET)).drop("_cell", "_in_cell", "_cells_before")


ORDER = ["_key", "_digest", "doc_id"]


def boundaries(rows: DataFrame) -> DataFrame:
    """For each source whose rest is not 0 (columns sid, rest): the row, or equal rows, in which the rest of the budget ends.

    ``edge`` holds what orders it, ``edge_before`` the sizes before it, ``edge_rows`` the number of equal rows.
    """
    rows = rows.select("sid", "rest", "size", *ORDER, F.floor(F.log("_key") * GRID).alias("_at")).filter("rest > 0")
    cells = rows.groupBy("sid", "_at").agg(F.sum("size").alias("_in"), F.first("rest").alias("rest"))
    before = Window.partitionBy("sid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_cells", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    ends_in = lambda start, size: (F.col(start) < F.col("rest")) & (F.col("rest") <= F.col(start) + size)
    last = stored(cells.filter(ends_in("_cells", F.col("_in"))).select("sid", "_at", "_cells"), "mix-cells")
    inside = rows.join(small_side(last), ["sid", "_at"])
    groups = inside.groupBy("sid", *ORDER).agg(F.count("*").alias("edge_rows"), F.max("size").alias("size"), F.first("rest").alias("rest"), F.first("_cells").alias("_cells"))
    groups = running(bucketed(stored(groups, "mix-edges")), ["sid"], "_bucket", list(map(F.col, ORDER)), {"_inner": F.col("edge_rows") * F.col("size")})
    groups = groups.withColumn("edge_before", F.col("_cells") + F.col("_inner")).filter(ends_in("edge_before", F.col("edge_rows") * F.col("size")))
    return stored(groups.select("sid", F.struct(*ORDER).alias("edge"), "edge_before", "edge_rows"), "mix-boundaries")


def mix(docs: DataFrame, seed: str = SEED, cycle: tuple[int, ...] = CYCLE, most: float = MOST, id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with size, source_size, target, taken (words) and copies (whole documents to emit), and the columns in ``keep``.

    ``weight`` names a column with quality weights above 0, such as a classifier's
    score; without it, and where it is null, 0, negative or not finite, they come from
    the text. ``copies`` counts the document on the
    boundary if at least half of it is taken.
    """
    t = text_or_empty(F.col(text))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), t))
    own = quality_weight(F.col(text))
    if weight:
        given = F.col(weight).cast("double")
        usable = (given > 0) & ~F.isnan(given) & (given < float("inf"))
    rows = docs.select(
        F.col(id).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(words(F.col(text))).cast("long").alias("size"),
        (F.coalesce(F.when(usable, given), own) if weight else own).alias("_weight"),
        digest.alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
        *keep,
    )
    rows = stored(rows, "mix-rows")
    of_source = F.struct("source")
    epochs = F.coalesce(F.expr("bigint(floor(target / nullif(source_size, 0)))"), F.lit(0))
    table = sources(rows, cycle, most).withColumn("epochs", epochs)
    table = stored(table.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-sources")
    rows = attach(rows.withColumn("_s", of_source), table.withColumn("_s", of_source).drop("source"), "_s", "n").drop("_s", "n")
    u = (F.conv(F.substring("_digest", 1, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52 + 1)
    rows = rows.withColumn("_key", -F.log(u) / F.col("_weight"))
    edges = boundaries(rows)
    rows = rows.join(small_side(edges), "sid", "left")
    here = F.struct(*ORDER)
    at_edge = F.coalesce(here == F.col("edge"), F.lit(False))
    # all of the rows before, none of those behind, and of equal rows on the edge one after the other
    part = F.when(here < F.col("edge"), F.col("size")).when(at_edge, F.least(F.col("size"), F.col("rest") - F.col("edge_before"))).otherwise(0)
    many = at_edge & (F.col("edge_rows") > 1)
    out = rows.filter(~many).withColumn("_part", part)
    if edges.filter("edge_rows > 1").limit(1).count():
        equal = stored(rows.filter(many), "mix-equal").withColumn("_share", F.pmod(F.xxhash64("_row"), F.lit(1_000_003)))
        equal = equal.withColumn("_bucket", F.floor(F.col("_share") / 1_000_003 * buckets_for(F.col("edge_rows"))))
        equal = running(equal, ["sid"], "_bucket", [F.col("_share"), F.col("_row")], {"_nth": F.lit(1)})
        left = F.col("rest") - F.col("edge_before") - F.col("_nth") * F.col("size")
        out = out.unionByName(equal.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), left))).select(*out.columns))
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("_part")).alias("taken"),
        (F.col("epochs") + ((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("size"))).cast("long")).alias("copies"),
        *keep,
    )


def emit(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, **options) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it as a whole.

    Rows go with their decision from the first read on, so texts are stored once and not shuffled.
    """
    names = {c: f"_doc_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    taken = mix(renamed, id=names[id], text=names[text], source=names[source], weight=names[weight] if weight else None, keep=tuple(names.values()), **options)
    emitted = taken.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return emitted.select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM documents
), r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    greatest(0.1, (1 - 4 * CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS DOUBLE) / CAST(greatest(1, length(t)) AS DOUBLE))
      * (1 - CAST(length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS DOUBLE) / CAST(greatest(1, length(t)) AS DOUBLE))
      * (CAST(len(list_distinct(lines)) AS DOUBLE) / CAST(greatest(1, len(lines)) AS DOUBLE))) AS weight,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t) AS digest
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM r GROUP BY source
), w AS (
  SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, round(coalesce(least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE cap >= level * w)), cap), 6) AS target FROM l
), k AS (
  SELECT doc_id, size, source_size, target, digest, -ln((CAST(('0x' || substr(digest, 1, 13)) AS BIGINT) + 1) / (pow(2, 52) + 1)) / weight AS key, r.source AS source
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS epochs
  FROM k
)
SELECT doc_id, size, source_size, target,
  epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS taken
FROM b
"""
