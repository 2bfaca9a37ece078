"""Tables over any frame: crosstabs, shares, running windows, histograms, fits and summaries by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import beside


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share): counts of each pair, and their share of the row."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def numeric_by_group(df: DataFrame, group: str, *values: str) -> DataFrame:
    """Per group its rows, and mean, median and sample deviation of every value; null where a group has none."""
    stats = [f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("median", F.median), ("sd", F.stddev_samp))]
    return df.groupBy(group).agg(F.count("*").alias("n"), *stats)


def group_profile(df: DataFrame, group: str, label: str, k: int = 3) -> DataFrame:
    """(group, n, labels, purity, entropy, entropy_norm, share1..k): how a group's members spread over labels; 0 past its last label."""
    n = df.groupBy(group, label).agg(F.count("*").alias("c"))
    whole, order = Window.partitionBy(group), Window.partitionBy(group).orderBy(F.desc("c"), label)
    n = n.withColumn("p", F.col("c") / F.sum("c").over(whole)).withColumn("r", F.row_number().over(order))
    tops = [F.coalesce(F.max(F.when(F.col("r") == j, F.col("p"))), F.lit(0.0)).alias(f"share{j}") for j in range(1, k + 1)]
    out = n.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("labels"), F.max("p").alias("purity"), F.sum(-F.col("p") * F.log("p")).alias("entropy"), *tops)
    return out.withColumn("entropy_norm", F.when(F.col("labels") > 1, F.col("entropy") / F.log("labels")).otherwise(0.0))


def modal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): its commonest value, the least of equally common ones; nulls don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def dense(df: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Every whole number from `first` to `last` as `key`, with the columns of `df`, 0 where it has no row."""
    return df.sparkSession.range(first, last + 1).select(F.col("id").cast(df.schema[key].dataType).alias(key)).join(df, key, "left").na.fill(0)


def zero_filled(master: DataFrame, key: str, *counts: DataFrame) -> DataFrame:
    """The rows of `master` with the columns of all count tables, 0 where one has no row for the key."""
    for table in counts:
        master = master.join(table, key, "left")
    return master.na.fill(0)


def moving_average(df: DataFrame, order: str, value: str, window: int, by: str | None = None) -> DataFrame:
    """Add `smooth`: the mean over `window` (odd) rows around each; past either end the end value stands."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half, whole = window // 2, Window.partitionBy(*[by] if by else [])
    run = whole.orderBy(order)
    near = run.rowsBetween(-half, half)
    ends = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(run), F.count("*").over(whole)
    low, high = F.greatest(F.lit(0), half + 1 - at), F.greatest(F.lit(0), half - (n - at))
    total = F.sum(value).over(near) + low * F.first(value).over(ends) + high * F.last(value).over(ends)
    return df.withColumn("smooth", total / window)


def differences(df: DataFrame, order: str, value: str, by: str | None = None) -> DataFrame:
    """Add `slope` and `curvature`: first and second differences along `order`; null where there is none."""
    run = Window.partitionBy(*[by] if by else []).orderBy(order)
    out = df.withColumn("slope", F.col(value) - F.lag(value).over(run))
    return out.withColumn("curvature", F.col("slope") - F.lag("slope").over(run))


def log_histogram(df: DataFrame, year: str, value: str, per_decade: int = 10) -> DataFrame:
    """(year, bin, n): rows per year and logarithmic bin of a positive value; others are left out."""
    bin_ = F.floor(F.log10(F.col(value).cast("double")) * per_decade + 1e-9).cast("long")
    return df.where(F.col(value) > 0).groupBy(year, bin_.alias("bin")).agg(F.count("*").alias("n"))


def run_stats(curves: DataFrame, step: str, *values: str) -> DataFrame:
    """Mean and population deviation over runs at each step."""
    return curves.groupBy(step).agg(F.count("*").alias("runs"), *[f(v).alias(f"{v}_{name}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def line_fit(df: DataFrame, x: Column, y: Column, t: float | None = None) -> DataFrame:
    """(n, slope, intercept, r2, low, high): least squares, and the slope's interval for a t quantile (null without one)."""
    xy = df.select(x.alias("x"), y.alias("y"))
    fit = xy.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"))
    half = F.lit(t).cast("double") * F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    half = F.when(F.col("n") > 2, half)
    return fit.select("n", "slope", "intercept", "r2", (F.col("slope") - half).alias("low"), (F.col("slope") + half).alias("high"))


def top_share_cut(df: DataFrame, value: str, share: float = 0.2, least: int = 2) -> DataFrame:
    """(cut): the value that the top `share` of rows reach, at least `least`."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    # A row per distinct value: a degree, say, and no more of them than the largest one.
    above = n.withColumn("above", F.sum("n").over(Window.orderBy(F.desc(value)))).transform(beside, df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("want")))
    return above.where(F.col("above") >= F.col("want")).agg(F.greatest(F.max(value), F.lit(least)).alias("cut"))
