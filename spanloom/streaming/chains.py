"""Chains of alignments as a stream: places, gaps and islands are given out as a read's elements arrive.

A read's state is its last element and three counts, whatever the length of its chain.
Reads lie in buckets, and a bucket's elements of one batch are placed together by arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.functions.scratch import new_path
from spanloom.operators.chains import MAX_GAP, ORDER, PENALTY

#: What a chain needs of an element, with the order of a read's elements first.
ELEMENT = {"ord": "long", "line": "long", "part": "long", "s": "long", "e": "long", "contig": "string", "rev": "boolean", "contig_length": "long"}
#: What is kept of a read; ``until`` is the time at which it is closed.
KEPT = {"read": "long", **ELEMENT, "place": "long", "island": "long", "n_late": "long", "until": "long"}
STATE = ", ".join(f"{c} array<{t}>" for c, t in KEPT.items())
OUTPUT = "kind string, read long, ord long, line long, part long, place long, gap long, island long, n_late long"
#: Groups of reads that share a state. A stream keeps the number with which it was begun.
BUCKETS = 1024

_NUMPY = {"long": np.int64, "boolean": np.bool_, "string": np.object_}
Arrays = dict[str, np.ndarray]


def neighbour_gaps(rows: Arrays) -> np.ndarray:
    """The gap from each row to the next, as ``operators.chains.gap`` defines it."""
    s, e, rev, n, contig = (rows[c] for c in ("s", "e", "rev", "contig_length", "contig"))
    first, last, end = np.where(rev, e, s), np.where(rev, s, e), np.where(rev, s, n - e)
    near = np.where((last[:-1] > first[1:]) & (first[:-1] < last[1:]), 0, np.abs(last[:-1] - first[1:]))
    return np.where(contig[:-1] == contig[1:], near, end[:-1] + end[1:] + PENALTY)


def advance(known: Arrays, rows: Arrays, max_gap: int, until: int) -> tuple[list[pd.DataFrame], Arrays]:
    """(rows of ``OUTPUT``, what is kept from now on) of reads of which ``known`` is kept, when ``rows`` arrive in any order.

    Both are sorted together, a read's last element before new ones equal to it: what
    lies before it is late. ``until`` is kept for the reads of ``rows``.
    """
    both = {c: np.concatenate([known[c], rows[c]]) for c in ("read", *ELEMENT)}
    new = np.arange(len(both["read"])) >= len(known["read"])
    keys = [pd.factorize(both[c], sort=True)[0] if c == "contig" else both[c] for c in ORDER]
    order = np.lexsort([new, *keys[::-1], both["read"]])
    both, new, old = {c: v[order] for c, v in both.items()}, new[order], order[~new[order]]
    at = np.arange(len(new))
    starts = np.flatnonzero(_changes(both["read"]))
    of = np.cumsum(_changes(both["read"])) - 1  # the number of each row's read
    last = starts.copy()
    last[of[~new]] = at[~new]
    place, island, n_late = (np.zeros(len(starts), np.int64) for _ in range(3))
    for base, c in ((place, "place"), (island, "island"), (n_late, "n_late")):
        base[of[~new]] = known[c][old]
    closes = np.zeros(len(starts), np.int64)
    closes[of[~new]] = known["until"][old]
    closes[of[new]] = until
    late = at < last[of]
    out = []
    if late.any():
        out.append(_output("late", {c: v[late] for c, v in both.items()} | {"n_late": (n_late[of] + at - starts[of] + 1)[late]}))
    n_late += last - starts

    both, new, of = ({c: v[~late] for c, v in both.items()}, new[~late], of[~late])
    first = _changes(of)
    heads = np.flatnonzero(first)
    gap = np.concatenate([[0], neighbour_gaps(both)]).astype(np.int64)
    cuts = np.cumsum((gap > max_gap) & ~first)
    placed = both | {"place": place[of] + np.arange(len(of)) - heads[of], "island": island[of] + cuts - cuts[heads][of], "n_late": n_late[of], "until": closes[of]}
    if new.any():
        gaps = pd.arrays.IntegerArray(gap, first)[new]
        out.append(_output("element", {c: v[new] for c, v in placed.items()} | {"gap": gaps}))
    ends = np.append(heads[1:], len(of)) - 1
    return out, {c: placed[c][ends] for c in KEPT}


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each of the sorted ``values``, of which there is one at least, is the first of its kind."""
    return np.concatenate([[True], values[1:] != values[:-1]])


def _output(kind: str, rows: Arrays) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    n = len(rows["read"])
    none = lambda: pd.arrays.IntegerArray(np.zeros(n, np.int64), np.ones(n, np.bool_))
    given = {c: pd.array(rows[c], dtype="Int64") if c in rows else none() for c in names[1:]}
    return pd.DataFrame({"kind": np.full(n, kind, np.object_), **given})


def islands_stream(elements: DataFrame, max_gap: int = MAX_GAP, timeout_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``OUTPUT`` for a stream of chain elements, in append mode.

    Kind ``element``: an element with its place in the read's chain, the gap to the one
    before (null for the first) and its island, equal to what ``chains.islands`` finds over
    the whole table as long as no batch brings an element that belongs before one of an
    earlier batch. Within a batch order is made here. Kind ``late``: an element that came
    too late for its place; it has none and changes nothing but the read's n_late, the
    number of its late elements so far. Kind ``closed``, with ``timeout_ms``: no element
    of the read came for that long; place and island are its last ones, its state is
    dropped, and an element that comes still begins a new chain.

    Equal elements take one place each. Elements with a null in one of the columns of
    ``ELEMENT`` or in read take no part; other columns are ignored. Reads are dealt into
    ``buckets`` by a hash, and a bucket's elements of one batch meet in one task, with what
    is kept of its reads: the source's limit on a batch (``maxFilesPerTrigger``,
    ``maxBytesPerTrigger``) bounds memory, not the length of the chain.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = 0 if timeout_ms is None else state.getCurrentProcessingTimeMs()
        values = state.get if state.exists else [[] for _ in KEPT]
        known = {c: np.array(v, _NUMPY[t]) for v, (c, t) in zip(values, KEPT.items())}
        came = [f for f in frames if len(f)] if not state.hasTimedOut else []
        if came:
            rows = pd.concat(came, ignore_index=True)
            rows = {c: rows[c].to_numpy(_NUMPY[KEPT[c]]) for c in ("read", *ELEMENT)}
            out, known = advance(known, rows, max_gap, now + (timeout_ms or 0))
            yield from out
        if timeout_ms is not None:
            due = known["until"] < now
            if due.any():
                yield _output("closed", {c: known[c][due] for c in ("read", "place", "island", "n_late")})
                known = {c: v[~due] for c, v in known.items()}
        if not len(known["read"]):
            state.remove()
            return
        state.update(tuple(known[c].tolist() for c in KEPT))
        if timeout_ms is not None:
            state.setTimeoutDuration(max(1, int(known["until"].min()) - now))

    used = elements.select(F.col("read").cast("long").alias("read"), *[F.col(c).cast(t).alias(c) for c, t in ELEMENT.items()]).dropna()
    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    dealt = used.withColumn("_bucket", F.pmod(F.xxhash64("read"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)


def replayed(elements: DataFrame, max_gap: int = MAX_GAP, rows_an_arrival: int = 5_000_000, least: int = 3) -> DataFrame:
    """``islands_stream`` over a table whose elements arrive in the order of ``ord``, each arrival as new files in a folder.

    The stream ends with each arrival and is begun again with the next one, so its state
    comes from the checkpoint. There is one arrival for ``rows_an_arrival`` rows, but
    ``least`` of them; rows of one ``ord`` arrive together. Rows are dealt into arrivals
    once, so an arrival reads no other one's rows.
    """
    spark = elements.sparkSession
    n = max(least, -(-elements.count() // rows_an_arrival))
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n)
    staged, folder, state, out = (new_path(spark, name) for name in ("staged", "arrivals", "stream-state", "streamed"))
    ranged = elements.repartitionByRange(n * files, "ord").withColumn("_arrival", F.floor(F.spark_partition_id() / files).cast("int"))
    ranged.write.partitionBy("_arrival").parquet(staged)
    rows = spark.read.schema(ranged.schema).parquet(staged)
    for k in range(n):
        rows.filter(F.col("_arrival") == k).drop("_arrival").write.mode("append").parquet(folder)
        stream = islands_stream(spark.readStream.schema(elements.schema).parquet(folder), max_gap)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
