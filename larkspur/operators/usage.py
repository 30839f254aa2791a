"""Usage analytics: latency, rollups, message counts, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key count, sum, avg, min, max and nearest-rank p95 of raw samples."""
    x, n = F.col("x"), F.col("n")
    totals = [F.sum("n").alias("count"), F.sum(x * n).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max")]
    return _ranked(samples, keys, value, {"p95": 0.95}, totals).withColumn("avg", F.col("sum") / F.col("count"))


def percentiles(samples: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the samples at floor(count * share), counted from zero in order, or the last: a column for each name."""
    return _ranked(samples, keys, value, shares, [])


def _ranked(samples: DataFrame, keys: list[str], value: str, shares: dict[str, float], more: list[Column]) -> DataFrame:
    """Equal samples are counted first, so what is put in order for a key is its different values, not its samples."""
    counted = samples.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    d = counted.withColumns({"upto": F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    at = lambda p: F.least(F.floor(F.col("all") * p), F.col("all") - 1)
    return d.groupBy(*keys).agg(*more, *[F.min(F.when(F.col("upto") > at(p), F.col("x"))).alias(name) for name, p in shares.items()])


def merge_latency(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partials (count, sum, min, max, p95) merged: avg from sums, p95_max as the greatest of the partials' p95."""
    aggs = [F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("p95").alias("p95_max")]
    g = partials.groupBy(*keys).agg(*aggs) if keys else partials.agg(*aggs)
    return g.where("count > 0").withColumn("avg", F.col("sum") / F.col("count"))


def nearest_rank(ordered: Column, p: float) -> Column:
    """The element at floor(n * p) of a sorted array, counted from zero, or the last."""
    n = F.size(ordered)
    return F.get(ordered, F.least(F.floor(n * p).cast("int"), n - 1))


def rollup_sets(df: DataFrame, dims: list[str], measures: list[Column]) -> DataFrame:
    """Totals by each dimension alone and over all, in one pass: the dimensions (null where not grouped by) and `dim`."""
    sets = [[F.col(d)] for d in dims] + [[]]
    marks = F.lit("total")
    for d in dims:
        marks = F.when(F.grouping(d) == 0, F.lit(d)).otherwise(marks)
    return df.groupingSets(sets, *[F.col(d) for d in dims]).agg(*measures, marks.alias("dim"))


def runs_by_model(runs: DataFrame) -> DataFrame:
    """job, model (null for the job's total), runs, token sums, missing_usage; total is what is given or input and output."""
    clean = lambda c: F.greatest(F.lit(0).cast("long"), F.floor(F.coalesce(c, F.lit(0))).cast("long"))
    total = clean(F.coalesce(F.col("total"), F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0))))
    missing = F.col("input").isNull() & F.col("output").isNull() & F.col("total").isNull()
    return runs.groupingSets([[F.col("job"), F.col("model")], [F.col("job")]], "job", "model").agg(
        F.count("*").alias("runs"), F.sum(clean(F.col("input"))).alias("input_tokens"), F.sum(clean(F.col("output"))).alias("output_tokens"),
        F.sum(total).alias("total_tokens"), F.count_if(missing).alias("missing_usage"), F.grouping("model").cast("int").alias("is_total"),
    )


def cumulative(points: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """Running sums `cum_<value>` within each session."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values})


def range_totals(points: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Totals of points with a time between two bounds, in either order; no row without points."""
    inside = points.where(F.col("ts").between(F.least(lo, hi), F.greatest(lo, hi)))
    g = inside.agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count_if(F.col("input") > 0).alias("user_messages"), F.count_if(F.col("output") > 0).alias("assistant_messages"), (F.max("ts") - F.min("ts")).alias("duration"), F.count("*").alias("n"))
    return g.where("n > 0").drop("n")


def session_summary(events: DataFrame, key: str, ts: str) -> DataFrame:
    """first, last, duration_s and the sorted days of activity of each session."""
    g = events.groupBy(key).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.sort_array(F.collect_set(F.date_format(ts, "yyyy-MM-dd"))).alias("days"))
    return g.withColumn("duration_s", F.unix_micros(F.col("last").cast("timestamp")) / 1e6 - F.unix_micros(F.col("first").cast("timestamp")) / 1e6)
