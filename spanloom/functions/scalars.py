"""Column functions on sequences, qualities and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def reverse_complement(s: Column) -> Column:
    """Null where a letter other than ACGT stands in the sequence."""
    up = F.upper(s)
    return F.when(~up.rlike("[^ACGT]"), F.reverse(F.translate(up, "ACGT", "TGCA")))


def compress_homopolymers(s: Column) -> Column:
    return F.regexp_replace(s, r"(.)\1+", "$1")


def error_probability(phred: Column) -> Column:
    return F.pow(F.lit(10.0), -phred / F.lit(10.0))


def char_error_probability(c: Column) -> Column:
    return error_probability(F.ascii(c) - 33)


def kmers(s: Column, k: int) -> Column:
    """The 2-bit codes (A 0, C 1, G 2, T 3) of all k-mers of a sequence, in order; null where another letter stands in one.

    Letters become an array once a row, and codes of q letters (q a divisor of k)
    once more, so a k-mer takes q + k / q look-ups and the cost is linear.
    """

    def joined(part: int, parts: int):
        """From an array of codes of ``part`` letters, that of ``part * parts`` letters."""

        def codes(xs: Column) -> Column:
            last = F.size(xs) - part * (parts - 1) - 1
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
            piece = lambda i, j: F.get(xs, i + j * part) * 4 ** (part * (parts - 1 - j))
            return F.transform(starts, lambda i: sum((piece(i, j) for j in range(1, parts)), piece(i, 0)))

        return codes

    digit = lambda c: F.when(c == "A", 0).when(c == "C", 1).when(c == "G", 2).when(c == "T", 3).cast("long")
    out = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), digit)
    q = max((d for d in range(2, k) if k % d == 0 and d * d <= 2 * k), default=1)
    for part, parts in ((1, q), (q, k // q)) if q > 1 else ((1, k),):
        out = F.transform(F.array(out), joined(part, parts))[0]
    return out


def is_marker(kmer: Column, density: float, modulus: int = 101) -> Column:
    return kmer % modulus < int(round(modulus * density))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), 1)
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), p.substr(F.lit(1), F.length(p) - 1).cast("long").alias("len")))


def consumes_reference(op: Column) -> Column:
    return op.isin("M", "D", "N", "=", "X")


def consumes_query(op: Column) -> Column:
    return op.isin("M", "I", "S", "=", "X")


def diagonal(x: Column, y: Column, y_size: Column | int) -> Column:
    return (F.lit(y_size) if isinstance(y_size, int) else y_size) - 1 - y + x


def antidiagonal(x: Column, y: Column) -> Column:
    return x + y


def chromosome_order(name: Column) -> list[Column]:
    """Sort keys for contig names: those with a plain number by number, then those with letters, mixed ones last."""
    bare = F.regexp_replace(name, "^(?i)chr", "")
    number = bare.rlike(r"^\d+$")
    letters = bare.rlike(r"^[A-Za-z]+$")
    return [F.when(number, 0).when(letters, 1).otherwise(2), F.when(number, bare.cast("long")), bare]


def x_of(diagonal: Column, antidiagonal: Column, y_size: Column | int) -> Column:
    """The inverse of ``diagonal`` and ``antidiagonal``: x."""
    return F.floor((antidiagonal + diagonal + 1 - y_size) / 2)


def y_of(diagonal: Column, antidiagonal: Column, y_size: Column | int) -> Column:
    return F.floor((antidiagonal - diagonal + y_size - 1) / 2)


def kmer_letters(code: Column, k: int) -> Column:
    """The letters of a k-mer's 2-bit code."""
    return F.concat(*[F.substring(F.lit("ACGT"), F.shiftright(code, 2 * (k - 1 - j)).bitwiseAND(3).cast("int") + 1, 1) for j in range(k)])


def without_strand(label: Column) -> Column:
    return F.regexp_replace(label, "[+-]$", "")


def match_stop(start: Column, length: Column) -> Column:
    """The last place of a match on one sequence; its start for one without letters."""
    return F.when(length > 0, start + length - 1).otherwise(start)
