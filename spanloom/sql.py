"""Functions for queries that are written in SQL alone: call ``register(spark)`` once a session.

Scalar functions are SQL functions, so they stay in the JVM and are optimised like any
expression; ``exact_matches`` is a table function over Arrow batches, to be called with a
partitioned table argument.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from spanloom.functions.shipping import ship_package
from spanloom.operators.matches import seeds

#: name(arguments) and result of each scalar function, with its body.
SCALARS = {
    "reverse_complement(s STRING)": ("STRING", "CASE WHEN NOT upper(s) RLIKE '[^ACGT]' THEN reverse(translate(upper(s), 'ACGT', 'TGCA')) END"),
    "compress_homopolymers(s STRING)": ("STRING", r"regexp_replace(s, '(.)\\1+', '$1')"),
    "kmer_letters(code BIGINT, k INT)": ("STRING", "array_join(transform(sequence(k - 1, 0, -1), i -> substr('ACGT', CAST(shiftright(code, 2 * i) & 3 AS INT) + 1, 1)), '')"),
    "kmer_code(s STRING)": ("BIGINT", "CASE WHEN length(s) BETWEEN 1 AND 31 AND NOT s RLIKE '[^ACGT]' THEN aggregate(split(s, ''), 0L, (code, c) -> CASE WHEN c = '' THEN code ELSE code * 4 + instr('ACGT', c) - 1 END) END"),
    "cigar_ops(cigar STRING)": ("ARRAY<STRUCT<op: STRING, len: BIGINT>>", r"transform(regexp_extract_all(cigar, '(\\d+[MIDNSHPX=])', 1), p -> named_struct('op', right(p, 1), 'len', CAST(left(p, length(p) - 1) AS BIGINT)))"),
    "reference_length(cigar STRING)": ("BIGINT", r"aggregate(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), 0L, (n, x) -> n + CAST(x AS BIGINT))"),
    "query_length(cigar STRING)": ("BIGINT", r"aggregate(regexp_extract_all(cigar, '(\\d+)[MIS=X]', 1), 0L, (n, x) -> n + CAST(x AS BIGINT))"),
    "error_probability(q STRING)": ("DOUBLE", "pow(10.0D, -(ascii(q) - 33) / 10.0D)"),
}


@arrow_udtf(returnType="a long, b long, x long, y long, len long")
class ExactMatches:
    """Maximal exact matches of each row's two sequences: rows (a, b, one, two, k), where matches have ``k`` letters or more."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        a, b, one, two, k = (rows.column(c) for c in ("a", "b", "one", "two", "k"))
        for r in range(rows.num_rows):
            x, y, n = seeds(one[r].as_py() or "", two[r].as_py() or "", k[r].as_py())
            if len(x):
                yield pa.table({"a": pa.array(np.full(len(x), a[r].as_py())), "b": pa.array(np.full(len(x), b[r].as_py())), "x": pa.array(x), "y": pa.array(y), "len": pa.array(n)})


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to ``spark.sql`` in this session."""
    for head, (result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    ship_package(spark).udtf.register("exact_matches", ExactMatches)
    return spark
