"""Chains of exact matches as Spark joins: edges to the nearest match on each diagonal, scores by relaxation, the best chain by doubling.

A match scores its length; a change of diagonal costs one a step and one to open. Chains
begin free within ``reach`` of either sequence's beginning and end free within ``reach`` of
either end. A match that no chain from a border reaches begins with the cost of both
sequences. Of equal predecessors the earliest counts, and any before the border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spanloom.functions.scratch import stored

PAIR = ["a", "b"]


def nodes(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """Stored matches with a number each (id) and the sizes of their sequences (``sizes``: read, size)."""
    side = lambda c, n: sizes.select(F.col("read").alias(c), F.col("size").alias(n))
    rows = matches.select(*PAIR, "x", "y", "len").join(side("a", "x_size"), "a").join(side("b", "y_size"), "b")
    return stored(rows.withColumn("id", F.monotonically_increasing_id()), "chain-nodes")


def edges(nodes: DataFrame, reach: int) -> DataFrame:
    """u, v, w: from each match to the nearest that begins on each diagonal near its last place; w is what v adds to a chain that comes from u.

    A diagonal t off is searched from the border of the box on, over reach + 1 - t
    antidiagonals. Beginnings lie in tiles as wide as the box, so a tile holds no more than
    (reach + 1) ** 2 of a pair's matches; a match looks into four.
    """
    width = reach + 1
    tile = lambda c: F.floor(F.col(c) / width)
    two = lambda c: F.explode(F.array(tile(c), tile(c) + 1))
    ends = nodes.select(*PAIR, F.col("id").alias("u"), (F.col("x") + F.col("len") - 1).alias("sx"), (F.col("y") + F.col("len") - 1).alias("sy"), (F.col("x") - F.col("y")).alias("d"))
    ends = ends.withColumn("_tx", two("sx")).withColumn("_ty", two("sy"))
    begins = nodes.select(*PAIR, F.col("id").alias("v"), "x", "y", "len", tile("x").alias("_tx"), tile("y").alias("_ty"))
    off = F.abs((F.col("x") - F.col("y")) - (F.col("sx") - F.col("sy")))
    beyond = F.col("x") + F.col("y") - F.col("sx") - F.col("sy") - off
    met = ends.join(begins, [*PAIR, "_tx", "_ty"]).filter((F.col("x") >= F.col("sx")) & (F.col("y") >= F.col("sy")) & (off <= reach) & (beyond <= reach + 1 - off))
    first = met.groupBy("u", (F.col("x") - F.col("y")).alias("d2")).agg(F.min(F.struct((F.col("x") + F.col("y")).alias("at"), "v", "len")).alias("m"), F.first("d").alias("d"))
    gap = F.abs(F.col("d2") - F.col("d"))
    return first.filter(F.col("m.v") != F.col("u")).select("u", F.col("m.v").alias("v"), (F.col("m.len") - F.when(gap > 0, gap + 1).otherwise(0)).alias("w"))


def scores(nodes: DataFrame, edges: DataFrame, reach: int) -> DataFrame:
    """``nodes`` with the score of the best chain that ends in each, and prev, the match before it there (null: the chain begins here).

    Each round hands the scores that rose along their edges; a pair in which none rose is
    done and leaves. There are as many rounds as the longest chain has matches, at most.
    """
    edges = stored(edges, "chain-edges")
    unreached = -1 - F.col("x_size") - F.col("y_size")
    bordering = (F.col("x") <= reach) | (F.col("y") <= reach)
    now = nodes.select("id", *PAIR, F.when(bordering, F.greatest(unreached, F.col("len"))).otherwise(unreached).alias("score"), F.lit(True).alias("rose"))
    now, done = stored(now, "chain-scores"), []
    while True:
        risen = now.filter("rose")
        offered = edges.join(risen.select(F.col("id").alias("u"), "score"), "u").groupBy(F.col("v").alias("id")).agg(F.max(F.col("score") + F.col("w")).alias("_s"))
        better = F.coalesce(F.col("_s") > F.col("score"), F.lit(False))
        after = now.join(offered, "id", "left").select("id", *PAIR, F.when(better, F.col("_s")).otherwise(F.col("score")).alias("score"), better.alias("rose"))
        after = stored(after, "chain-scores")
        active = after.filter("rose").select(*PAIR).distinct()
        if not active.limit(1).count():
            done.append(after)
            break
        done.append(after.join(active, PAIR, "left_anti"))
        now = stored(after.join(active, PAIR, "left_semi"), "chain-active")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    found = stored(found.drop("rose", *PAIR), "chain-found")
    whole = nodes.join(found, "id")
    # the earliest of the predecessors that give a match its score
    source = whole.select(F.col("id").alias("u"), F.col("score").alias("s"), F.struct("x", "y", "len", "id").alias("place"))
    target = whole.select(F.col("id").alias("v"), "score", unreached.alias("least"))
    led = edges.join(source, "u").join(target, "v").filter((F.col("s") + F.col("w") == F.col("score")) & (F.col("score") > F.col("least")))
    back = led.groupBy(F.col("v").alias("id")).agg(F.min("place")["id"].alias("prev"))
    return stored(whole.join(back, "id", "left"), "chain-scored")


def best_chains(scored: DataFrame, reach: int) -> DataFrame:
    """a, b, score, step, x, y, len of the best chain of each pair that ends near a border.

    The chain's matches are found from its last one by pointers that double each round.
    """
    at_end = (F.col("x") + F.col("len") - 1 >= F.col("x_size") - reach) | (F.col("y") + F.col("len") - 1 >= F.col("y_size") - reach)
    last = scored.filter(at_end).groupBy(*PAIR).agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "x", "y", "len")).alias("m"))
    chain = stored(last.select("m.id", F.col("m.score").alias("total")), "chain-ends")
    jump = stored(scored.filter("prev is not null").select("id", F.col("prev").alias("to")), "chain-jumps")
    while True:
        more = stored(chain.join(jump, "id").select(F.col("to").alias("id"), "total"), "chain-more")
        if not more.limit(1).count():
            break
        # after k rounds a chain holds its last 2 ** k matches, and a jump goes over as many
        chain = stored(chain.unionByName(more), "chain-part")
        jump = stored(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")), "chain-jumps")
    steps = Window.partitionBy(*PAIR).orderBy("x", "y", "len")
    rows = scored.join(chain, "id").withColumn("step", (F.row_number().over(steps) - 1).cast("long"))
    return rows.select(*PAIR, F.col("total").alias("score"), "step", "x", "y", "len")
