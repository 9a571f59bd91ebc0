"""Operator 6, byte-pair encoding and decoding.

Encoding. An Aho-Corasick automaton of all tokens gives the longest token from a
place in a pre-token, and a table the next shorter one that begins alike. The
encoder takes longest tokens from left to right; a token that is not compatible
with the one before it is replaced by the next shorter token, and where none is
left the encoder steps back. Two tokens are compatible if the merges, applied to their joined bytes, give
just these two; a sequence whose neighbours are all compatible is the result of
the merges. That is found without merging: every token has a table entry of the
two tokens it was last merged from and that merge's rank, and the border between
two tokens is walked back through these entries, latest merge first, looking for a
pair across the border that would have merged earlier. A start once found hopeless
is not tried again, so the time is linear in the pre-token (token lengths are
bounded by the vocabulary). Pre-tokens repeat, so results are kept in two tables of
bounded size: when the newer one is full it becomes the older, whose entries come
back when they are met again.

Decoding. All tokens' bytes stand in one buffer with a table of offsets; a
document's ids gather their bytes in one indexed read.

Defined results. Null text counts as empty: no ids. The added token's string in a
text becomes its id, as in the tokenizers library. Null or repeated ids: each row
by itself. A text of any length is coded whole, in the task that reads it. Empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm.common import documents, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Seen(dict):
    """Pre-tokens with what ``make`` gives for them. A full table is set aside as the older one; long pre-tokens are not kept."""

    KEPT, LONGEST = 150_000, 64

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.older: dict = {}

    def __missing__(self, s: str):
        made = self.older.get(s)
        if made is None:
            made = self.make(s.encode("utf-8", "surrogatepass"))
        if len(s) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.older = dict(self)
                self.clear()
            self[s] = made
        return made


class Bpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = {bytes(back[c] for c in s): i for s, i in j["model"]["vocab"].items() if all(c in back for c in s)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        to_bytes = lambda s: bytes(back[c] for c in s)
        self.rank = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.by_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = regex.compile(public_tokenizers.PATTERN)
        #: Tokens that the merges can reach; only these may stand in a result.
        self.ids: dict[bytes, int] = {}
        size = max([*raw.values(), *self.added.values()]) + 1
        # a token's rank is that of its last merge (-1 for one byte), its halves are what that merge joined
        self.ranks, self.halves = [-1] * size, [(0, 0)] * size
        for t, i in raw.items():
            if len(t) > 1:
                last = self.last_merge(t)
                if last is None:
                    continue
                self.ranks[i], self.halves[i] = self.rank[last], (raw[last[0]], raw[last[1]])
            self.ids[t] = i
        #: Rank of the merge of two tokens, by both ids in one number.
        self.joined = {raw[a] << 32 | raw[b]: r for (a, b), r in self.rank.items() if a in raw and b in raw}
        self.automaton = ahocorasick.Automaton()
        #: Of each token, the longest one that is a shorter beginning of it; -1 where none is.
        self.shorter = [-1] * size
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
            self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids))
        table = [b""] * size
        for t, i in raw.items():
            table[i] = t
        for s, i in self.added.items():
            table[i] = s.encode()
        self.buffer = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.sizes, self.decimals = list(map(len, table)), list(map(str, range(size)))
        self.lengths = np.array(self.sizes, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.compatible: dict[int, bool] = {}
        self.seen = Seen(lambda data: np.array(self.pieces(data), dtype="<i4").tobytes())
        self.counts = Seen(lambda data: len(self.pieces(data)))

    def last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of a token's own bytes joins; None if the merges do not end in the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges keep the border between two tokens."""
        pair = a << 32 | b
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) > 300_000:
                self.compatible.clear()
            known = self.compatible[pair] = self.border_stays(a, b)
        return known

    def border_stays(self, x: int, y: int) -> bool:
        ranks, halves, joined = self.ranks, self.halves, self.joined
        # x and y touch the border until one of them is merged away from it: pairs of a rank under ``limit`` come before that
        limit = 1 << 60
        while joined.get(x << 32 | y, limit) >= limit:
            rx, ry = ranks[x], ranks[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                limit, x = rx, halves[x][1]
            else:  # of equal merges the left one is made first: (x, y) of this rank would come before that within y
                limit, y = ry + 1, halves[y][0]
        return False

    def pieces(self, data: bytes) -> list[int]:
        """The ids of one pre-token, by backtracking over the longest matches."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        text, n = data.decode("latin-1"), len(data)
        longest, shorter, sizes, fits, most = self.automaton.iter_long, self.shorter, self.sizes, self.fits, self.longest
        hopeless = bytearray(n + 1)
        out: list[int] = []
        # matches are asked for in stretches of two longest tokens, so that a new start costs no more than that
        at, stop = 0, min(n, 2 * most)
        run = longest(text[:stop])
        first = i = next(run)[1]
        while True:
            while i >= 0 and (hopeless[at + sizes[i]] or (out and not fits(out[-1], i))):
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at += sizes[i]
                if at == n:
                    return out
                if i != first or (at + most > stop and stop < n):  # the run went on behind a longer token, or nears its end
                    stop = min(n, at + 2 * most)
                    run = longest(text[at:stop])
                first = i = next(run)[1]
            else:
                hopeless[at] = 1
                last = out.pop()
                at -= sizes[last]
                first, i = -1, shorter[last]

    def by_parts(self, text: str, table: Seen, of_added) -> list:
        """What ``table`` has for the pre-tokens of a text, and ``of_added`` gives for the id of an added token in it."""
        split = self.split.findall
        if not self.by_added or not any(s in text for s in self.added):
            return list(map(table.__getitem__, split(text)))
        out, at = [], 0
        for m in self.by_added.finditer(text):
            out += map(table.__getitem__, split(text, at, m.start()))
            out.append(of_added(self.added[m[0]]))
            at = m.end()
        out += map(table.__getitem__, split(text, at))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of a text, and the same as decimals joined by commas."""
        ids = np.frombuffer(b"".join(self.by_parts(text, self.seen, lambda i: np.array([i], dtype="<i4").tobytes())), dtype="<i4")
        return ids, ",".join(map(self.decimals.__getitem__, ids.tolist()))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self.buffer[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - n), n)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """The vocabulary of a file, read once in each worker."""
    return Bpe(path)


def encode(docs: DataFrame, path: str = VOCABULARY, id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``id``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves (array<int>), for each row."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            counts, sums, backs, ids = [], [], [], []
            for t in batch.column("text"):
                got, decimals = bpe.encode(t.as_py())
                counts.append(len(got))
                sums.append(hashlib.sha256(decimals.encode()).hexdigest())
                backs.append(hashlib.sha256(bpe.decode(got).encode()).hexdigest())
                if keep_ids:
                    ids.append(got)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            if keep_ids:
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    return docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).alias("text")).mapInArrow(run, fields)


def decode(coded: DataFrame, path: str = VOCABULARY, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id`` and the decoded text of each row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x, dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    whole = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return coded.select(F.col(id).cast("long").alias("doc_id"), whole.alias("ids")).mapInArrow(run, "doc_id long, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), keep_ids=False)
