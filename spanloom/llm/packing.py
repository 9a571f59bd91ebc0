"""Operator 13, packing documents into sequences by cutting-stock column generation.

Every document is cut into pieces of at most the sequence length; most have one. The
lengths of the pieces fall into classes (exact up to 64 tokens, then 32 for each
doubling), whose counts are the only thing that reaches the driver: at most 224 numbers,
whatever the size of the corpus. There a linear program over patterns (how many pieces
of each class one sequence holds) is solved by column generation: a knapsack by dynamic
programming finds the pattern with the best value under the present prices, and the
program is done when no pattern is worth more than ``TOLERANCE`` above the cost of a
sequence. Whole parts of the solution are used as they are, what rounding leaves over
(fewer sequences than there are classes, at most) is filled first-fit by falling size.

Pieces are ranked within their class by shuffles of small rows, and a table of
(class, first rank, last rank, pattern), which is broadcast, gives each its sequence.

A class is as long as its longest piece, so sequences have gaps. A share of the
documents, chosen by a hash, is kept out of the program and cut to fill them: gaps and
these documents are laid end to end on two lines, and where the lines overlap a piece
begins and ends. What is left of the second line fills sequences of its own, the last
of them sequences of powers of two, so no padding is needed. If the share does not
suffice for the gaps, the work begins anew with a larger share, at last with all.

Defined results. Null text is empty; an empty document is its end token. Null or
repeated ids and repeated rows are separate documents. A text of any length is coded
whole, in the task that reads it. Empty tables give empty results. Other columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from spanloom.llm.common import documents, stored, text_or_empty
from spanloom.llm.ranks import buckets_for, running, sorted_running

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LENGTH, END = 2048, 1
#: Shares of the documents that are cut to fill gaps: the first that suffices.
SHARES = (1 / 16, 1 / 4, 1)
#: How far from its least possible number of sequences, or after how many columns, the linear program may stop.
TOLERANCE, PRICINGS = 0.001, 5000
#: Tokens of the line of gaps that are matched with documents in one group.
BLOCK = 1 << 16


class WordBpe:
    """Ids of texts by the tokenizers library, which is asked once for each pre-token that a worker meets (two tables of bounded size)."""

    KEPT, LONGEST = 150_000, 64
    #: A pre-token begins and ends where the vocabulary's own pattern has it: no match goes over white space.
    PIECE = regex.compile(r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")
    #: The same for texts of no letter beyond U+00FF.
    SHORT = re.compile("[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ends = self.tokenizer.model.end_of_word_suffix or ""
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([bool(ends) and (self.tokenizer.id_to_token(i) or "").endswith(ends) for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of these pre-tokens. They are coded in one text: a pre-token's last id, and no other, ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(pieces):
            return {p: ids[a:b].tobytes() for p, a, b in zip(pieces, [0, *stops[:-1].tolist()], stops.tolist())}
        return {p: self.whole(p) for p in pieces}

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian numbers of 32 bits."""
        if any(a in text for a in self.added):
            return self.whole(text)
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        try:
            text.encode("latin-1")
            pieces = self.SHORT.findall(text)
        except UnicodeEncodeError:
            pieces = self.PIECE.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            missing = {p for p, f in zip(pieces, found) if f is None}
            more = {p: self.older[p] for p in missing if p in self.older}
            fresh = [p for p in missing if p not in more]
            for k in range(0, len(fresh), 10_000):
                more |= self.learn(fresh[k : k + 10_000])
            if len(self.known) + len(more) > self.KEPT:
                self.older, self.known = self.known, {}
            self.known |= {p: v for p, v in more.items() if len(p) <= self.LONGEST}
            found = [more[p] if f is None else f for p, f in zip(pieces, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """The vocabulary of a file, read once in each worker."""
    return WordBpe(path)


def coded(docs: DataFrame, share: float, path: str = VOCABULARY, length: int = LENGTH, end: int = END, id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, doc_tokens, stock, ids (of stock only) and crcs (of each ``length`` tokens of the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = vocabulary(path), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            tokens, ids, crcs = [], [], []
            for t, kept in zip(batch.column("text"), batch.column("stock").to_pylist()):
                data = bpe.encode(t.as_py()) + last
                tokens.append(len(data) // 4)
                ids.append(data if kept else None)
                crcs.append(None if kept else [zlib.crc32(data[k : k + 4 * length]) for k in range(0, len(data), 4 * length)])
            columns = [batch.column(c) for c in ("row", "doc_id", "stock")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.int64()), pa.array(ids, pa.binary()), pa.array(crcs, pa.list_(pa.int64()))], names=["row", "doc_id", "stock", "doc_tokens", "ids", "crcs"])

    row = F.monotonically_increasing_id()
    stock = F.pmod(F.xxhash64(row, F.lit("stock")), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).alias("text"), row.alias("row")).withColumn("stock", stock.alias("stock") if share < 1 else F.lit(True))
    return rows.select("row", "doc_id", "stock", "text").mapInArrow(run, "row long, doc_id long, stock boolean, doc_tokens long, ids binary, crcs array<long>")


def class_of(length: Column) -> Column:
    """The longest length of the class that a length from 1 on belongs to."""
    # bits of (length - 1) beyond the highest six are rounded up
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.length(F.bin((length - 1).cast("long"))) - 6))
    return (F.ceil(length / step) * step).cast("long")


def best_pattern(sizes: np.ndarray, prices: np.ndarray, length: int) -> np.ndarray:
    """The pattern of greatest value: an unbounded knapsack, where a class is offered as 1, 2, 4... pieces at once."""
    best, taken = np.zeros(length + 1), []
    for k in np.argsort(-prices / sizes):
        if prices[k] <= 0:
            break
        size, value, many = int(sizes[k]), prices[k], 1
        while size <= length:
            tried = best[: length + 1 - size] + value
            better = np.zeros(length + 1, dtype=bool)
            better[size:] = tried > best[size:] + 1e-12
            best[size:] = np.where(better[size:], tried, best[size:])
            taken.append((k, size, many, better))
            size, value, many = 2 * size, 2 * value, 2 * many
    pattern, left = np.zeros(len(sizes), dtype=np.int64), length
    for k, size, many, better in reversed(taken):
        if better[left]:
            pattern[k] += many
            left -= size
    return pattern


def first_basis(sizes: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A pattern for each class, and its amount: each takes the longest pieces that fit, until one of its classes is used up."""
    m, left = len(sizes), counts.astype(float)
    basis, amounts, order = np.zeros((m, m)), np.zeros(m), np.argsort(-sizes)
    for _ in range(m):
        pattern, room = np.zeros(m), length
        for k in order:
            pattern[k] = min(room // int(sizes[k]), max(1, np.ceil(left[k]))) if left[k] >= 0 else 0
            room -= int(pattern[k]) * int(sizes[k])
        ratios = np.divide(left, pattern, out=np.full(m, np.inf), where=pattern > 0)
        out = int(np.argmin(ratios))
        left = np.where(left < 0, left, np.maximum(left - ratios[out] * pattern, 0))
        left[out] = -1
        # the class that ends here is in no later pattern, so the basis is regular
        basis[:, out], amounts[out] = pattern, ratios[out]
    return basis, amounts


def patterns(sizes: np.ndarray, counts: np.ndarray, length: int = LENGTH, tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, int]]:
    """(pattern, sequences) that hold exactly ``counts`` pieces of ``sizes``: the rounded solution of the linear program."""
    m = len(sizes)
    basis, amounts = first_basis(sizes, counts, length)
    inverse = np.linalg.inv(basis) if m else basis
    # what the pieces fill, and with each pricing counts @ prices / value, bound the number of sequences from below
    bound = float(sizes @ counts) / length
    for _ in range(PRICINGS if m else 0):
        prices = inverse.sum(axis=0)
        column = best_pattern(sizes, np.maximum(prices, 0), length)
        value = prices @ column
        bound = max(bound, counts @ np.maximum(prices, 0) / max(value, 1.0))
        if value <= 1 + 1e-9 or amounts.sum() <= bound * (1 + tolerance):
            break
        d = inverse @ column
        ratios = np.where(d > 1e-9, amounts / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratios))
        amounts = np.maximum(amounts - ratios[out] * d, 0)
        amounts[out] = ratios[out]
        basis[:, out] = column
        pivot = inverse[out] / d[out]
        inverse = inverse - np.outer(d, pivot)
        inverse[out] = pivot
    whole = [(basis[:, k].astype(np.int64), int(amounts[k] + 1e-6)) for k in range(m)]
    left = counts.astype(np.int64).copy()
    kept = []
    for pattern, n in whole:
        n = min([n, *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if n > 0:
            left -= n * pattern
            kept.append((pattern, n))
    return kept + first_fit(sizes, left, length)


def first_fit(sizes: np.ndarray, counts: np.ndarray, length: int) -> list[tuple[np.ndarray, int]]:
    """Sequences that take the longest pieces that still fit; equal ones are made at once."""
    out, left, order = [], counts.copy(), np.argsort(-sizes)
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), length
        for k in order:
            n = min(int(left[k]), room // int(sizes[k]))
            pattern[k] = n
            room -= n * int(sizes[k])
        many = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= many * pattern
        out.append((pattern, many))
    return out


def assigned(spark: SparkSession, pieces: DataFrame, length: int) -> tuple[DataFrame, int]:
    """Stored ``pieces`` (row, start, length and others) with sequence_id, offset and used (tokens of the sequence), and the number of sequences."""
    pieces = pieces.withColumn("_class", class_of(F.col("length")))
    counts = sorted((r["_class"], r["n"]) for r in pieces.groupBy("_class").agg(F.count("*").alias("n")).collect())
    sizes, n = np.array([c for c, _ in counts], dtype=np.int64), np.array([k for _, k in counts], dtype=np.int64)
    ranges, at, ranks = [], 0, dict.fromkeys(sizes.tolist(), 0)
    for pattern, many in patterns(sizes, n, length):
        for k in np.flatnonzero(pattern).tolist():
            size, each = int(sizes[k]), int(pattern[k])
            ranges.append((size, ranks[size], ranks[size] + many * each, each, at))
            ranks[size] += many * each
        at += many
    per = spark.createDataFrame(ranges, "_class long, low long, high long, each long, first long").groupBy("_class").agg(F.collect_list(F.struct("low", "high", "each", "first")).alias("_ranges"), F.max("high").alias("_n"))
    # a class's pieces in the order of a hash, in buckets of even size; its classes and ranges are at most 224 each
    share = F.pmod(F.xxhash64("row", "start"), F.lit(1 << 40)) / float(1 << 40)
    rows = pieces.join(F.broadcast(per), "_class").withColumns({"_share": share, "_bucket": F.floor(share * buckets_for(F.col("_n")))})
    ranked = running(stored(rows.select(*pieces.columns, "_share", "_bucket"), "pack-rows"), ["_class"], "_bucket", [F.col("_share"), F.col("row"), F.col("start")], {"_rank": F.lit(1)})
    own = lambda a: F.filter(a, lambda x: (x["low"] <= F.col("_rank")) & (F.col("_rank") < x["high"]))[0]
    placed = ranked.join(F.broadcast(per), "_class").withColumn("_own", own(F.col("_ranges")))
    placed = placed.withColumn("sequence_id", F.col("_own.first") + F.floor((F.col("_rank") - F.col("_own.low")) / F.col("_own.each")))
    within = Window.partitionBy("sequence_id")
    before = within.orderBy(F.desc("length"), "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({"offset": F.coalesce(F.sum("length").over(before), F.lit(0)), "used": F.sum("length").over(within)})
    return placed.select(*[c for c in pieces.columns if c != "_class"], "sequence_id", "offset", "used"), at


def tail(left: int, length: int, first: int) -> list[tuple[int, int]]:
    """(sequence, tokens) for fewer tokens than a sequence: one for each power of two in their number, the greatest first."""
    sizes = [1 << k for k in reversed(range(length.bit_length())) if left >> k & 1]
    return [(first + k, s) for k, s in enumerate(sizes)]


def refined(stock: DataFrame, gaps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces of documents where two lines overlap (row, start, length, sequence_id, offset).

    ``stock`` (row, at, tokens) and ``gaps`` (sequence_id, offset, at, tokens) lie end to end
    from 0 to one end, at ``at``. Both are cut at the borders of blocks; in a block, a piece
    goes from each beginning to the next, and belongs to the last document and gap that began.
    """
    cut = lambda df: df.withColumn("_block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("tokens") - 1) / block))))
    place = F.greatest(F.col("at"), F.col("_block") * block)
    inside = place - F.col("at")
    nothing = F.lit(None).cast("struct<row:bigint,start:bigint>"), F.lit(None).cast("struct<sequence_id:bigint,offset:bigint>")
    of_docs = cut(stock).select("_block", place.alias("at"), (F.col("at") + F.col("tokens")).alias("stop"), F.struct("row", inside.alias("start")).alias("doc"), nothing[1].alias("gap"))
    of_gaps = cut(gaps).select("_block", place.alias("at"), F.lit(None).cast("long").alias("stop"), nothing[0].alias("doc"), F.struct("sequence_id", (F.col("offset") + inside).alias("offset")).alias("gap"))
    # all that begins at one place is one event
    events = of_docs.unionByName(of_gaps).groupBy("_block", "at").agg(F.max("stop").alias("stop"), F.max("doc").alias("doc"), F.max("gap").alias("gap"))
    order = Window.partitionBy("_block").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    began = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("at").alias("at"))), True).over(so_far)
    rows = events.withColumns({"d": began("doc"), "g": began("gap"), "end": F.last("stop", True).over(so_far), "next": F.coalesce(F.lead("at").over(order), (F.col("_block") + 1) * block)})
    return rows.select(
        F.col("d.v.row").alias("row"),
        (F.col("d.v.start") + F.col("at") - F.col("d.at")).alias("start"),
        (F.least("next", "end") - F.col("at")).alias("length"),
        F.col("g.v.sequence_id").alias("sequence_id"),
        (F.col("g.v.offset") + F.col("at") - F.col("g.at")).alias("offset"),
    )


def checksums(pieces: DataFrame, stock: DataFrame) -> DataFrame:
    """``pieces`` of stored ``stock`` with doc_id, doc_tokens and ids_crc32; a document meets its pieces once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for ids, places in zip(batch.column("ids"), batch.column("pieces").to_pylist()):
                data = ids.as_py()
                crcs.append([zlib.crc32(data[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in places])
            rest = [batch.column(c) for c in ("doc_id", "doc_tokens", "pieces")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "pieces", "crcs"])

    own = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    rows = stock.join(own, "row").select("doc_id", "doc_tokens", "ids", "pieces")
    done = rows.mapInArrow(run, "doc_id long, doc_tokens long, pieces array<struct<start:long,length:long,sequence_id:long,offset:long>>, crcs array<long>")
    each = done.select("doc_id", "doc_tokens", F.explode(F.arrays_zip("pieces", "crcs")).alias("p"))
    return each.select("doc_id", "p.pieces.start", "p.pieces.length", F.col("p.crcs").alias("ids_crc32"), "doc_tokens", "p.pieces.sequence_id", "p.pieces.offset")


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, end: int = END, shares: tuple[float, ...] = SHARES, id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each piece, see ``op13_packing``. ``length`` is a power of two from 64 on; the last of ``shares`` is 1."""
    spark = docs.sparkSession
    for share in shares:
        tokens = stored(coded(docs, share, path, length, end, id, text), "pack-tokens")
        n = F.size("crcs")
        each = tokens.filter(~F.col("stock")).select("row", "doc_id", "doc_tokens", F.posexplode("crcs").alias("_k", "ids_crc32"))
        start = F.col("_k").cast("long") * length
        pieces = each.select("row", "doc_id", "doc_tokens", start.alias("start"), F.least(F.lit(length).cast("long"), F.col("doc_tokens") - start).alias("length"), "ids_crc32")
        placed, sequences = assigned(spark, pieces, length)
        placed = stored(placed, "pack-placed")
        gaps = placed.filter((F.col("offset") == 0) & (F.col("used") < length)).select("sequence_id", F.col("used").alias("offset"), (F.lit(length) - F.col("used")).alias("tokens"))
        room = gaps.agg(F.sum("tokens")).first()[0] or 0
        stock = tokens.filter("stock")
        spare = (stock.agg(F.sum("doc_tokens")).first()[0] or 0) - room
        if spare >= 0:
            break
    # what is left of the line of documents fills sequences of its own
    new, left = divmod(spare, length)
    own = spark.range(new).select((F.col("id") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(length).cast("long").alias("tokens"), (F.lit(room) + F.col("id") * length).alias("at"))
    last, at = [], room + new * length
    for sequence, size in tail(left, length, sequences + new):
        last.append((sequence, 0, size, at))
        at += size
    own = own.unionByName(spark.createDataFrame(last, "sequence_id long, offset long, tokens long, at long"))
    lined = sorted_running(gaps, [F.col("sequence_id")], {"at": F.col("tokens")}).unionByName(own)
    line = sorted_running(stock.select("row", F.col("doc_tokens").alias("tokens")), [F.col("row")], {"at": F.col("tokens")})
    filled = checksums(refined(line, lined, block), stock)
    return placed.select(*COLUMNS).unionByName(filled.select(*COLUMNS))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
