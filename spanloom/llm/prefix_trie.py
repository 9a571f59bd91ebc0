"""Operator 12, conversation prefix trie by truncation peeling.

A conversation is the sequence of its turns' digests. The peeling begins at the
greatest depth: conversations that end there are grouped by their whole sequence, and
each group is a node. Last turns are stripped, conversations that end higher up join the
nodes that survive, and what is equal now is grouped again, down to the root. What a
subtree adds up to goes along: members and leaves are sums, the representative a
minimum, and the children are counted as they are stripped. All of these are combined
before the shuffle, so a turn that a third of all conversations begin with is no large
group. Texts never leave the task that reads them; a turn travels as 16 bytes of SHA-256
and the length of its text.

A round strips STRIDE turns at once: a row passes through the prefixes that it has in the
round's depths, and each node adds itself to those above it. So the number of Spark jobs
is the greatest depth divided by STRIDE, not by one. Each round is written to the shared
folder.

The ids of the conversations that end in a node are hashed in their order. They are
sorted in ranges over all nodes, each range's task joins them to pieces of text, and one
task a node runs over its pieces, in order, without holding them: a hash goes byte by
byte, but only that is left to one task where a node has very many ends.

A conversation's digests and sizes stand in one row, 24 bytes a turn and about as long
as the trie is deep; its family's rows meet in one group.

Defined results. Null role or text is empty. Rows without a conv_id belong to no
conversation. Null turns come first; turns of equal number are ordered by their digest.
Repeated rows are repeated turns. A text of any length is one turn. A conversation
whose turns are all taken away is a member of the root. An empty table gives no nodes.
Other columns are ignored. c % 5 of a negative id has the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.functions.shipping import ship_package
from spanloom.llm.common import stored, text_or_empty
from spanloom.llm.lookups import lookup

FAMILY, CUT = 5, 9
#: Turns that a round strips.
STRIDE = 64
PATH = "array<struct<d:binary,bytes:bigint>>"


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn: equal ones mean equal role and text."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and path, the digests and sizes of its turns in order, for each conversation."""
    own = F.struct(F.col(turn).alias("turn"), _digest(role, text).alias("d"), _bytes(text).alias("bytes"))
    grouped = turns.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(own)).alias("all"))
    return grouped.select("conv_id", _in_order("all").alias("path"))


def _digest(role: str, text: str) -> Column:
    return turn_digest(text_or_empty(F.col(role)), text_or_empty(F.col(text)))


def _bytes(text: str) -> Column:
    return F.octet_length(text_or_empty(F.col(text))).cast("long")


def _in_order(rows: str | Column) -> Column:
    """Digest and size of sorted turns, null turn numbers first (sorting puts them last)."""
    bare = lambda part: F.transform(part, lambda x: F.struct(x["d"].alias("d"), x["bytes"].alias("bytes")))
    return F.concat(bare(F.filter(rows, lambda x: x["turn"].isNull())), bare(F.filter(rows, lambda x: x["turn"].isNotNull())))


def rebuilt(turns: DataFrame, family: int = FAMILY, cut: int = CUT) -> DataFrame:
    """conv_id and path of each conversation after it took its beginning from the first of its family (columns as in ``conversations``).

    Conversations c of one c - c % family meet in one group, which holds the digests of at most that many.
    """
    c = F.col("conv_id").cast("long")
    row = F.struct(F.col("turn").alias("turn"), _digest("role", "text").alias("d"), _bytes("text").alias("bytes"))
    rows = turns.filter(c.isNotNull()).select(c.alias("c"), (c - c % family).alias("base"), row.alias("row"))
    one = rows.groupBy("base").agg(F.collect_list(F.struct("c", "row")).alias("all"))
    of = lambda member: F.array_sort(F.transform(F.filter("all", lambda x: x["c"] == member), lambda x: x["row"]))
    members = F.array_distinct(F.transform("all", lambda x: x["c"]))
    each = one.select(_in_order(of(F.col("base"))).alias("first"), F.explode(F.transform(members, lambda m: F.struct(m.alias("c"), _in_order(of(m)).alias("own")))).alias("m"))
    h = (F.crc32(F.col("m.c").cast("string").cast("binary")) % cut).cast("int")
    head = F.slice("first", 1, h)
    rest = F.slice("m.own", h + 1, F.greatest(F.lit(1), F.size("m.own")))
    return each.select(F.col("m.c").alias("conv_id"), F.concat(head, rest).cast(PATH).alias("path"))


#: The key of the root.
ROOT = bytes(16)


def _key(path: str, depth: Column | int) -> Column:
    """The key of the first ``depth`` turns: the chained digest of the last of them."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(ROOT)).otherwise(F.get(path, depth - 1)["d"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's digest becomes that of all turns up to it, so it stands for the whole prefix."""
    for batch in batches:
        lists = batch.column("path")
        digests, sizes = lists.flatten().field("d").to_pylist(), lists.flatten().field("bytes")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = 0
        for end in ends.tolist():
            key = b""
            for k in range(at, end):
                key = digests[k] = hashlib.sha256(key + digests[k] + sizes[k].as_py().to_bytes(8, "little")).digest()[:16]
            at = end
        values = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), sizes], names=["d", "bytes"])
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.ListArray.from_arrays(offsets, values)], names=["conv_id", "path"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and conv_id become one row for each key in a batch, with the ids as text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype="V16")
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], n)
        ids = batch.column("conv_id").to_pylist()
        first = batch.take(pa.array(starts))
        text = [",".join(map(str, ids[a:b])) for a, b in zip(starts.tolist(), ends.tolist())]
        columns = [first.column("key"), first.column("path"), first.column("conv_id"), pa.array((ends - starts).astype(np.int64)), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "path", "conv_id", "n", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and least id become one row for each key, with the hash of all of its ids."""
    names, held, path_type = ["path", "conv_id", "n", "ends_sha256"], None, None

    def out(rows):
        at = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(at[0], path_type), pa.array(at[1], pa.int64()), pa.array(at[2], pa.int64()), pa.array(at[3], pa.string())], names=names)

    for batch in batches:
        done, path_type = [], batch.schema.field("path").type
        for key, path, c, n, text in zip(*(batch.column(k).to_pylist() for k in ("key", "path", "conv_id", "n", "ids"))):
            if held is not None and held[0] == key:
                held[3] += n
                held[4].update(b"," + text.encode())
            else:
                if held is not None:
                    done.append((held[1], held[2], held[3], held[4].hexdigest()))
                held = [key, path, c, n, hashlib.sha256(text.encode())]
        if done:
            yield out(done)
    if held is not None:
        yield out([(held[1], held[2], held[3], held[4].hexdigest())])


def ended(convs: DataFrame) -> DataFrame:
    """path (of chained digests), conv_id (least), n and ends_sha256 for each distinct path of whole conversations."""
    chained = convs.select("conv_id", F.col("path").cast(PATH)).mapInArrow(_chain, f"conv_id long, path {PATH}")
    keyed = chained.select(_key("path", F.size("path")).alias("key"), "conv_id", "path")
    ranged = keyed.repartitionByRange(F.col("key"), F.col("conv_id")).sortWithinPartitions("key", "conv_id")
    pieces = ranged.mapInArrow(_pieces, f"key binary, path {PATH}, conv_id long, n long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, f"path {PATH}, conv_id long, n long, ends_sha256 string")


NO_ENDS = hashlib.sha256(b"").hexdigest()


def peeled(rows: DataFrame, low: int, high: int) -> DataFrame:
    """The nodes of depths ``low`` to ``high``, which all of ``rows`` lie in, with what their subtrees add up to.

    A row is the end of a conversation or a node below, stripped to depth ``high`` (child 1).
    It passes through the nodes of its prefixes; then every node adds itself to the nodes above it.
    """
    long = lambda c: c.cast("long")
    n = F.size("path")
    # Spark may look at the size of this array before it drops the rows that end higher up
    depths = F.when(n >= low, F.sequence(F.lit(low), n)).otherwise(F.array().cast("array<int>"))
    keys = F.transform(depths, lambda i: F.struct(i.alias("depth"), _key("path", i).alias("key")))
    met = rows.withColumn("keys", keys).select("*", F.explode("keys").alias("at"))
    ends_here = F.col("at.depth") == n
    here = lambda c: F.sum(F.when(ends_here, F.col(c)).otherwise(0))
    node = met.groupBy(F.col("at.key").alias("key"), long(F.col("at.depth")).alias("depth")).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.max(F.when(ends_here, F.col("ends_sha256"))).alias("ends_sha256"),
        here("child").alias("child"),
        here("leaves").alias("leaves"),
        here("saved").alias("saved"),
        F.max((~ends_here).cast("int")).alias("passed"),
        F.first(F.transform(F.slice("keys", 1, F.col("at.depth") - low + 1), lambda x: x["key"])).alias("keys"),
        F.first(F.get("path", F.col("at.depth") - 1)["bytes"]).alias("bytes"),
        # the topmost nodes keep their path for the next stride
        F.first(F.when(F.col("at.depth") == low, F.slice("path", 1, F.lit(low))), True).alias("path"),
        F.first(F.when((F.col("at.depth") == low) & (F.lit(low) > 0), _key("path", max(0, low - 1)))).alias("up"),
    )
    node = node.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0)))
    node = node.withColumn("leaves", F.col("leaves") + ((F.col("child") == 0) & (F.col("passed") == 0)).cast("long"))
    above = stored(node, "trie-met").select("*", F.posexplode("keys").alias("_k", "of"))
    behind = F.size("keys") - 1 - F.col("_k")
    own = F.first(F.when(behind == 0, F.struct("depth", "conv_id", "n_convs", "child", "ends_sha256", "path", F.coalesce("up", F.get("keys", F.size("keys") - 2)).alias("up"))), True)
    sums = above.groupBy(F.col("of").alias("key")).agg(own.alias("own"), F.sum((behind == 1).cast("long")).alias("below"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return sums.select("key", "own.up", "own.path", "own.conv_id", "own.depth", "own.n_convs", (F.col("own.child") + F.col("below")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("own.ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def trie(convs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, path), see ``op12_prefix_trie``; ``stride`` turns are stripped in a round."""
    zero = F.lit(0).cast("long")
    ends = stored(ended(convs).select("path", "conv_id", F.col("n").alias("n_convs"), zero.alias("child"), zero.alias("leaves"), zero.alias("saved"), "ends_sha256"), "trie-ends")
    high, paths_written, below = ends.agg(F.max(F.size("path"))).first()[0], [], None
    if high is None:
        fields = "conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, depth long, parent_conv_id long"
        return convs.sparkSession.createDataFrame([], fields)
    while high >= 0:
        low = max(0, high - stride + 1)
        rows = ends.filter(F.size("path").between(low, high))
        if below is not None:
            rows = rows.unionByName(below)
        nodes = stored(peeled(rows, low, high), "trie-nodes")
        paths_written.append(nodes)
        stripped = nodes.filter(F.col("depth") == low).select(F.slice("path", 1, F.lit(max(0, low - 1))).alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends_sha256"))
        below, high = stripped, low - 1
    keyed = paths_written[0].drop("path")
    for level in paths_written[1:]:
        keyed = keyed.unionByName(level.drop("path"))
    # a node's children are the rows that look it up, so popular parents are found without a large group
    parents = keyed.filter("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_in"))
    return lookup(keyed.drop("key"), parents, "up", "_in").drop("up", "_in")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ship_package(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return trie(rebuilt(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS k, role, text FROM t
), h AS (
  SELECT c, c - c % {FAMILY} AS base,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], range(8 * length(CAST(c AS VARCHAR)))), lambda r, i:
      xor(xor(r, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END) >> 1,
          CASE WHEN (xor(r, CASE WHEN i % 8 = 0 THEN ascii(substr(CAST(c AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % {CUT} AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT h.c, o.k, role, text FROM h JOIN o ON o.c = h.base AND o.k <= h.h
  UNION ALL
  SELECT h.c, o.k, role, text FROM h JOIN o ON o.c = h.c AND o.k > h.h
), s AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS turn, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM r
), p AS (
  SELECT c, d, bytes, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS path FROM s
  UNION ALL SELECT c, 0, 0, '' FROM h
), e AS (
  SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM p
), n AS (
  SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, count(*) FILTER (ends) AS n_ends,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM e GROUP BY path, d
), a AS (
  SELECT n.*, u.conv_id AS parent_conv_id, u.path AS up
  FROM n LEFT JOIN n AS u ON n.depth > 0 AND u.path = left(n.path, 64 * (n.depth - 1))
), k AS (
  SELECT up AS path, count(*) AS n_children FROM a WHERE up IS NOT NULL GROUP BY up
), w AS (
  SELECT a.*, coalesce(k.n_children, 0) AS n_children FROM a LEFT JOIN k ON a.path = k.path
), b AS (
  SELECT left(x.path, 64 * CAST(g.i AS BIGINT)) AS path, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved_tokens
  FROM w AS x, LATERAL (SELECT unnest(range(x.depth + 1)) AS i) AS g GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM w JOIN b ON w.path = b.path
"""
