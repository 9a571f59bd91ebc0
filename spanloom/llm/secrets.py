"""Operator 2, secret scans with an incremental ledger of blobs.

Every version of every path is content-addressed by the SHA-256 of its text. The
ledger records which (blob, rule, rule version) triples were scanned, with the
spans found. ``scan`` drops from the distinct blobs the pairs that the ledger
already has, scans the rest once each, adds them to the ledger and joins the
findings of all current rule versions back to every path. Copies of a blob cost
one scan; a rule that gets a new version rescans the blobs for that rule alone.

``marked`` reads each text once: its blob, and whether it holds one of the literals
that the rules need (an AWS prefix, a keyword, 16 hex digits). Only texts that do
are carried on; other blobs are entered in the ledger with no spans, and their rows
never meet a join. Repeated blobs are first combined within each task, so one blob
with a third of all rows meets the shuffle as one row a task, and its findings reach
its rows by broadcast (see ``lookup``).

Defined results. Null text counts as empty. Null or repeated paths keep one
result row for each input row. Spans are in code points, end exclusive. A text of
any length is scanned whole. Empty tables give empty results. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.llm.common import documents, stored, text_or_empty
from spanloom.llm.lookups import lookup


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, what a match must satisfy, and a literal (regular expression for Spark) that any text with a match holds."""

    kind: str
    version: int
    pattern: str
    screen: str
    base: bool = False
    accept: Callable[[re.Match], bool] = lambda m: True


#: A private key block: to the matching END line; without one, over header lines and then base64 lines (line breaks may be written as \\n).
#: A body ends at the next BEGIN or END, so a text with many BEGIN lines is read once. Base64 of under 16 characters must fill its line.
PEM = (
    r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1PRIVATE KEY-----"
    r"|(?:(?:\s|\\[rn])+[A-Za-z][A-Za-z0-9-]*:\x20[^\r\n\\]*)*"
    r"(?:(?:[\s>]|\\[rn])+[A-Za-z0-9+/]{16,}={0,2}|[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t>]*[A-Za-z0-9+/]+={0,2}(?=[\x20\t]*(?:[\r\n]|\\[rn]|\Z)))*)"
)

#: The base kinds in the order in which they are listed, then kinds of this library's own.
RULES = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"' ]*[:=]", True, lambda m: len(m[2]) >= 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{14}", True, lambda m: len(m[0]) >= 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", r"[0-9a-f]{16}", True),
    Rule("pem", 2, PEM, r"PRIVATE KEY-----"),
    Rule("forge", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{8}"),
)
SPAN = "struct<start:int,end:int>"


def spans(rule: Rule, text: str) -> list[dict]:
    """Leftmost non-overlapping matches; those that ``accept`` refuses are dropped after they took their place."""
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(rule.pattern, text) if rule.accept(m)]


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")


def _scan_blobs(todo: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind, version, spans) for rows (blob, text, kinds): the rules named in ``kinds``, on one text each."""
    fields = f"blob binary, found array<struct<kind:string,version:int,spans:array<{SPAN}>>>"
    kind = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = {r.kind: r for r in rules}
        for batch in batches:
            found = [[{"kind": k, "version": by_kind[k].version, "spans": spans(by_kind[k], t.as_py()) if t.is_valid else []} for k in ks] for t, ks in zip(batch.column("text"), batch.column("kinds").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, pa.list_(kind))], names=["blob", "found"])

    made = todo.select("blob", "text", "kinds").mapInArrow(run, fields)
    return made.select("blob", F.explode("found").alias("f")).select("blob", "f.kind", "f.version", "f.spans")


def by_blob(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, found) of the blobs with findings: spans of all kinds sorted by start, then by the rules' order."""
    order = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)]), F.col("kind"))
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), F.col("kind").alias("kind")))
    return ledger.filter(F.size("spans") > 0).select("blob", one.alias("s")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("found"))


def marked(versions: DataFrame, rules=RULES, path: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, blob, the text where a rule may match it (else null) and the columns in ``keep`` of every row, stored."""
    whole, screen = text_or_empty(F.col(text)), F.lit(False)
    for r in rules:
        screen = screen | whole.rlike(r.screen)
    return stored(versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"), F.when(screen, whole).alias("text"), *keep), "marked")


def findings(marks: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """As ``scan``, for rows that ``marked`` gave; ``marked`` must have known all of ``rules``."""
    spark = marks.sparkSession
    blobs = marks.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
    if ledger is None:
        todo = blobs.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
        open_rules = F.array_except(F.array(*wanted), F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>")))
        todo = blobs.join(done, "blob", "left").withColumn("kinds", F.transform(open_rules, lambda x: x["kind"])).filter(F.size("kinds") > 0)
    new = stored(_scan_blobs(todo, rules), "blob-ledger")
    known = new if ledger is None else new.unionByName(ledger.select("blob", "kind", "version", "spans").join(F.broadcast(rule_table(spark, rules)), ["kind", "version"], "left_semi"))
    maybe = marks.filter("text is not null").drop("text")
    found = stored(by_blob(known, rules).join(maybe.groupBy("blob").agg(F.count("*").alias("_rows")), "blob"), "found")
    nothing = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    told = lookup(maybe, found, "blob", "_rows").withColumn("found", F.coalesce("found", nothing)).drop("_rows")
    return told.unionByName(marks.filter("text is null").drop("text").withColumn("found", nothing)), new


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, path: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions`` and the rows to append to the ledger.

    ``ledger`` has columns blob, kind, version, spans. The findings have ``path``,
    ``blob``, the columns in ``keep`` and ``found``, an array of (start, end, kind)
    sorted by start, then by the rules' order.
    """
    return findings(marked(versions, rules, path, text, keep), ledger, rules)


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with its spans, overlapping ones as one, replaced by ``mark``; texts without spans are left as they are."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(before)).alias("out"))

    whole = F.aggregate(found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", rules=RULES) -> DataFrame:
    """The rows of ``docs`` with the secrets in their texts replaced; ``n_chars`` is renewed where the text changed.

    Rows are stored beside their marks, and only those that a rule may match are looked
    up by blob. Texts without findings stay as they are, null ones too.
    """
    names = {c: f"_doc_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    out, _ = scan(renamed.withColumn("_none", F.lit(None).cast("int")), rules=rules, path="_none", text=names[text], keep=tuple(names.values()))
    t = F.col(names[text])
    out = out.withColumn("_clean", F.when(F.size("found") > 0, redacted(t, F.col("found"))).otherwise(t))
    changed = F.size("found") > 0
    pick = {c: F.col(n) for c, n in names.items()} | {text: F.col("_clean")}
    if n_chars in names:
        pick[n_chars] = F.when(changed, F.length("_clean")).otherwise(F.col(names[n_chars])).cast(docs.schema[n_chars].dataType)
    return out.select(*[e.alias(c) for c, e in pick.items()])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds through the ledger: the base rules, then all rules, which scan only what the ledger lacks."""
    marks = marked(documents(spark, sf_dir))
    _, ledger = findings(marks, rules=tuple(r for r in RULES if r.base))
    out, _ = findings(marks, ledger)
    joined = lambda kinds: F.array_join(F.transform(F.filter("found", lambda s: s["kind"].isin(kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("path").alias("doc_id"), *map(count, base), F.sha2(joined(base), 256).alias("base_sha256"), joined([r.kind for r in RULES]).alias("spans"))
