"""Operator 10, edit-aware token counts.

Each document keeps its pre-tokens as (characters, tokens) leaves, in blocks under a
segment tree of sums. An edit finds its place from the top of the tree, re-splits the
text from a little before the edit until a pre-token border of the new text falls on
one of the old text, and counts tokens for those pre-tokens alone; then the sums above
the changed blocks are renewed. What lies before and after is not read again.

The split looks ahead, but never back: a pre-token depends on its own characters and
at most CONTEXT after it. So pre-tokens that end CONTEXT or more before the edit stay,
and from a shared border behind the edit on both texts split alike.

The leaves can be kept as a binary column from one round of edits to the next.

Defined results. Null text counts as empty. Edits apply in their order, each to the
text that the former ones left; places are in code points and are clamped to the text,
a null insert is empty, null edits are none. Null or repeated ids: each row by itself.
A text of any length is split whole once, in the task that reads it.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.llm.bpe import VOCABULARY, Bpe, vocabulary
from spanloom.llm.common import documents, text_or_empty

CONTEXT, PER_BLOCK = 24, 64
EDITS = "array<struct<start:int,stop:int,insert:string>>"


class Counter:
    """Splits and counts with one vocabulary; added tokens are pre-tokens of their own."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.added = bpe, tuple(bpe.added)
        self.plain = self.with_added = bpe.split
        if self.added:
            added = "|".join(map(regex.escape, sorted(bpe.added, key=len, reverse=True)))
            # a run of marks or of white space ends before an added token, as if the text ended there
            pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]+", rf"(?:(?!{added})[^\s\p{{L}}\p{{N}}])+").replace(r"\s+(?!\S)", rf"\s+(?:(?!\S)|(?={added}))")
            self.with_added = regex.compile(f"{added}|{pattern}")
            if max(map(len, bpe.added)) + 4 > CONTEXT:
                raise ValueError("an added token is longer than the context")

    def split(self, text: str) -> regex.Pattern:
        """The pattern to split a text by: the plain one where no added token stands in it."""
        return self.with_added if any(a in text for a in self.added) else self.plain

    def tokens(self, pre_token: str) -> int:
        return 1 if pre_token in self.added else self.bpe.counts[pre_token]

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        split = self.split(text)
        found = split.findall(text)
        return list(map(len, found)), list(map(self.bpe.counts.__getitem__ if split is self.plain else self.tokens, found))


class Tree:
    """Sums of characters and tokens over blocks of pre-tokens."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.blocks = [(chars[at : at + PER_BLOCK], tokens[at : at + PER_BLOCK]) for at in range(0, len(chars), PER_BLOCK)] or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for b, (c, t) in enumerate(self.blocks):
            self.chars[self.width + b], self.tokens[self.width + b] = sum(c), sum(t)
        for node in range(self.width - 1, 0, -1):
            self._renew(node)

    def _renew(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for c, _ in self.blocks for x in c], [x for _, t in self.blocks for x in t]

    def find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf in it, place where that leaf starts) of the first leaf that ends after ``at``; past the last leaf at the end."""
        if at >= self.chars[1]:
            last = len(self.blocks) - 1
            return last, len(self.blocks[last][0]), self.chars[1]
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if start + self.chars[node] <= at:
                start += self.chars[node]
                node += 1
        block = node - self.width
        for k, n in enumerate(self.blocks[block][0]):
            if start + n > at:
                return block, k, start
            start += n
        raise AssertionError("sums and leaves differ")

    def replace(self, first: tuple[int, int], last: tuple[int, int], chars: list[int], tokens: list[int]) -> None:
        """Put new leaves in place of those from ``first`` (block, leaf) up to, without, ``last``."""
        (a, i), (b, j) = first, last
        (ac, at), (bc, bt) = self.blocks[a], self.blocks[b]
        if a == b:
            self.blocks[a] = (ac[:i] + chars + ac[j:], at[:i] + tokens + at[j:])
        else:
            self.blocks[a] = (ac[:i] + chars, at[:i] + tokens)
            self.blocks[b] = (bc[j:], bt[j:])
            for k in range(a + 1, b):
                self.blocks[k] = ([], [])
        nodes = set()
        for k in range(a, b + 1):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(self.blocks[k][0]), sum(self.blocks[k][1])
            nodes.add((self.width + k) // 2)
        while nodes - {0}:
            for node in nodes:
                self._renew(node)
            nodes = {node // 2 for node in nodes if node > 1}


def edit(tree: Tree, text: str, counter: Counter, start: int, stop: int, insert: str) -> tuple[str, int]:
    """The new text, and the number of pre-tokens that were split and counted again; ``tree`` is brought up to date."""
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    new = text[:start] + insert + text[stop:]
    shift = len(new) - len(text)
    block, leaf, border = tree.find(max(0, start - CONTEXT))
    first, chars, tokens = (block, leaf), [], []
    old, place = border, border
    for m in counter.split(new).finditer(new, border):
        # old borders up to here, in places of the new text
        while place >= start + len(insert) and old < place - shift and block < len(tree.blocks):
            own = tree.blocks[block][0]
            if leaf < len(own):
                old += own[leaf]
                leaf += 1
            else:
                block, leaf = block + 1, 0
        if place >= start + len(insert) and place - shift == old and old >= stop:
            break
        chars.append(m.end() - m.start())
        tokens.append(counter.tokens(m[0]))
        place = m.end()
    else:
        block, leaf = len(tree.blocks) - 1, len(tree.blocks[-1][0])
    if block == len(tree.blocks):
        block, leaf = block - 1, len(tree.blocks[-1][0])
    tree.replace(first, (block, leaf), chars, tokens)
    return new, len(chars)


def recount(docs: DataFrame, path: str = VOCABULARY, id: str = "doc_id", text: str = "text", edits: str = "edits", leaves: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens before and n_tokens_edited after the edits, n_pre_tokens after them and n_recounted of them.

    ``leaves`` names the column with the leaves kept from an earlier round (null: the
    text is counted anew); ``keep`` adds the new text and leaves for the next one.
    """
    fields = "doc_id long, n_tokens long, n_tokens_edited long, n_pre_tokens long, n_recounted long" + ", text string, leaves binary" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path))
        for batch in batches:
            rows = []
            for t, es, kept in zip(batch.column("text"), batch.column("edits"), batch.column("leaves")):
                now = t.as_py()
                if kept.is_valid:
                    both = np.frombuffer(kept.as_py(), "<i4").reshape(2, -1).tolist()
                    tree = Tree(both[0], both[1])
                else:
                    tree = Tree(*counter.leaves(now))
                before, again = tree.n_tokens, 0
                for e in es.as_py():
                    if e is not None:
                        now, n = edit(tree, now, counter, e["start"] or 0, e["stop"] or 0, e["insert"] or "")
                        again += n
                row = [before, tree.n_tokens, sum(len(c) for c, _ in tree.blocks), again]
                if keep:
                    row += [now, np.array(tree.leaves(), dtype="<i4").tobytes()]
                rows.append(row)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()] * keep
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.split()[0] for f in fields.split(", ")])

    old = F.col(leaves) if leaves else F.lit(None).cast("binary")
    given = F.coalesce(F.col(edits), F.array().cast(EDITS))
    return docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(F.col(text)).alias("text"), given.cast(EDITS).alias("edits"), old.alias("leaves")).mapInArrow(run, fields)


def revisions(text: Column) -> Column:
    """The edits that the registered query makes in each document: a rewording, an insertion, a deletion, and a new last line."""
    n = F.length(text_or_empty(text))
    part = lambda a, b: F.floor(n * a / b).cast("int")
    one = lambda start, stop, insert: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(insert).alias("insert"))
    return F.array(one(part(1, 3), part(1, 3) + 12, " revised 2024 wording"), one(part(2, 3), part(2, 3), "\n\nEditor's note: "), one(part(1, 2), part(1, 2) + 30, ""), one(n + 64, n + 64, "\nEnd."))


def op10_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return recount(docs.select("doc_id", "text", revisions(F.col("text")).alias("edits")))
