"""Fixed-width histograms and what is derived from them. A value at the upper edge goes to the last bin; values outside are dropped unless a side is unbounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.operators.prefix import sorted_running


def bin_of(x: Column, start: float, stop: float, n_bins: int, unbounded: bool = False) -> Column:
    """The bin of a value, or null."""
    width = (stop - start) / n_bins
    b = F.floor((x - start) / F.lit(float(width)))
    b = F.when(x == stop, n_bins - 1).otherwise(b)
    if unbounded:
        return F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), b))
    return F.when((b >= 0) & (b <= n_bins - 1), b)


def whole_range(rows: DataFrame, x: str, width: int) -> tuple[int, int]:
    """(stop, number of bins) from 0 in bins of ``width`` so that the largest value lies in the last bin, under its edge."""
    most = rows.agg(F.max(x)).first()[0]
    n_bins = int((most or 0) // width) + 1
    return n_bins * width, n_bins


def histogram(rows: DataFrame, x: str, start: float, stop: float, n_bins: int, by: tuple[str, ...] = (), unbounded: bool = False) -> DataFrame:
    """Counts of the bins that are not empty: the columns in ``by``, bin, center, n."""
    width = (stop - start) / n_bins
    binned = rows.select(*by, bin_of(F.col(x), start, stop, n_bins, unbounded).cast("long").alias("bin")).filter("bin is not null")
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counts.select(*by, "bin", (F.lit(float(start)) + (F.col("bin") + 0.5) * width).alias("center"), "n")


def with_spine(counts: DataFrame, n_bins: int, start: float, stop: float) -> DataFrame:
    """One row for each bin, empty ones with n = 0. The spine's size is a parameter, so it is broadcast-safe."""
    width = (stop - start) / n_bins
    spine = counts.sparkSession.range(n_bins).select(F.col("id").alias("bin"), (F.lit(float(start)) + (F.col("id") + 0.5) * width).alias("center"))
    return spine.join(counts.select("bin", "n"), "bin", "left").select("bin", "center", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def density(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` with each bin's share of its group and its bases (n times center)."""
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    return counts.select("*", (F.col("n") / F.sum("n").over(whole)).alias("density"), (F.col("n") * F.col("center")).alias("bases"))


def n50(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The center of the first bin at which the running sum of bases passes half of all."""
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    bases = counts.withColumn("bases", F.col("n") * F.col("center"))
    run = bases.withColumns({"upto": F.sum("bases").over(whole.orderBy("bin")), "total": F.sum("bases").over(whole)})
    return run.filter(F.col("upto") > F.col("total") / 2).groupBy(*by).agg(F.min("center").alias("n50"))


def threshold_sums(rows: DataFrame, x: str, thresholds: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Sum and number of the values above each threshold, in one pass."""
    sums = [F.sum(F.when(F.col(x) > t, v).otherwise(0)).alias(f"{k}{i}") for i, t in enumerate(thresholds) for k, v in (("s", F.col(x)), ("c", F.lit(1)))]
    one = rows.groupBy(*by).agg(*sums)
    out = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"s{i}").cast("long").alias("total"), F.col(f"c{i}").cast("long").alias("n")) for i, t in enumerate(thresholds)])).alias("r")
    return one.select(*by, out).select(*by, "r.threshold", "r.total", "r.n")


def class_percent(rows: DataFrame, x: str, flag: str, start: float, stop: float, n_bins: int) -> DataFrame:
    """For each bin the percentage of flagged rows, with one pseudo-count a side."""
    b = rows.select(bin_of(F.col(x), start, stop, n_bins).cast("long").alias("bin"), flag).filter("bin is not null")
    sums = b.groupBy("bin").agg(F.sum(F.when(F.col(flag), 1).otherwise(0)).alias("yes"), F.sum(F.when(F.col(flag), 0).otherwise(1)).alias("no"))
    return sums.select("bin", "yes", "no", F.round(100.0 * (F.col("yes") + 1) / (F.col("yes") + F.col("no") + 2), 6).alias("percent"))


def per_region(rows: DataFrame, region: str, at: str, length: str, width: int) -> DataFrame:
    """Counts by region and bin of ``width``; a region has ceil(length / width) bins, by its largest length."""
    n_bins = rows.groupBy(F.col(region).alias("region")).agg(F.ceil(F.max(length) / width).cast("long").alias("n_bins"))
    counts = rows.groupBy(F.col(region).alias("region"), F.floor(F.col(at) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return counts.join(n_bins, "region").filter("bin >= 0 and bin < n_bins")


def subsample_rates(template: DataFrame, sample: DataFrame, n_bins: int, most: float, worst: int = 20) -> DataFrame:
    """For each bin the rate at which the sample's rows are kept to follow the template's distribution.

    Ratios of densities are divided by the mean ratio above 1 among the ``worst``
    bins by missing coverage, at most ``most``. Both inputs have one row for each
    bin (see ``with_spine``).
    """
    t = density(template).select("bin", "center", F.col("density").alias("t"), F.col("bases").alias("tb"))
    s = density(sample).select("bin", F.col("density").alias("s"))
    both = t.join(s, "bin").withColumn("ratio", F.when((F.col("t") > 0) & (F.col("s") > 0), F.col("t") / F.col("s")).otherwise(0.0))
    clip = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round(F.col("center") * (F.col("t") - F.col("s")), 9).desc(), "bin"))
    mean = both.withColumn("n", clip).filter((F.col("n") <= worst) & (F.col("ratio") > 1)).agg(F.least(F.coalesce(F.avg("ratio"), F.lit(1.0)), F.lit(float(most))).alias("reduction"))
    one = F.broadcast(mean)  # one row
    return both.join(one).select("bin", F.round("ratio", 6).alias("ratio"), F.round(F.col("ratio") / F.col("reduction"), 6).alias("rate"))


def modulo_subsample(rows: DataFrame, index: str, rate: float, modulus: int = 101) -> DataFrame:
    """Rows whose index modulo ``modulus`` is at most the rate's cutoff."""
    return rows.filter(F.pmod(F.col(index), F.lit(modulus)) <= int(round(modulus * rate)) - 1)


def prefix_by_sum(rows: DataFrame, group: list[str], order: list[str], x: str, most: int) -> DataFrame:
    """Rows of each group, in order, as long as the sum of those before is under ``most``; with that running sum."""
    before = sorted_running(rows, list(map(F.col, order)), {"_before": F.col(x)}, group)
    return before.withColumn("running", F.col("_before") + F.col(x)).filter(F.col("_before") < most).drop("_before")


def adaptive_range(rows: DataFrame, x: str, most: int = 500) -> tuple[float, float, int]:
    """(start, stop, bins) from the least to the largest value: one bin for each whole step between them, ``most`` at most."""
    r = rows.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    start, stop = float(r["a"] or 0), float(r["b"] or 0)
    return start, stop, max(1, min(int(stop - start), most))


def sample_by_length(rows: DataFrame, index: str, length: str, n: int, least: int, seed: int = 1) -> DataFrame:
    """``n`` rows of at least ``least`` in length, picked by a seeded hash of the index: the same on every run."""
    pick = F.md5(F.concat(F.lit(f"{seed}:"), F.col(index).cast("string")))
    return rows.filter(F.col(length) >= least).orderBy(pick, index).limit(n)
