"""Cubes from stored cells with mergeable sketches.

Events are aggregated once to cells of the finest grain (a row a combination of the dimensions), each
with counts, sums, a HyperLogLog sketch of a key and a quantile sketch of a value.  The cells are a table like any
other: cells of another day are appended, and every grouping set is merged from cells alone, never from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the HyperLogLog sketch (2 ** LG_K registers): relative standard error 1.04 / sqrt(2 ** LG_K), 1.6 %.
LG_K = 12
#: Size of the quantile sketch: ranks are right within about 1.33 %.
KLL_K = 200


def cells(rows: DataFrame, dims: dict[str, Column], key: str, value: str) -> DataFrame:
    """One row a combination of ``dims``: n, total, least and greatest ``value`` and the sketches of key and value.  Null
    values and keys are not sketched; a hot combination is aggregated in its tasks first."""
    exact = F.col(value).cast("decimal(28,6)")
    return rows.groupBy(*[c.alias(n) for n, c in dims.items()]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(exact).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.hll_sketch_agg(F.col(key).cast("string"), F.lit(LG_K)).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("ranks"),
    )


def cube(stored: DataFrame, dims: list[str], quantiles: tuple[float, ...] = (0.5, 0.95), names: tuple[str, ...] = ("p50", "p95")) -> DataFrame:
    """All grouping sets of ``dims`` from stored cells: the dimensions (null: all), ``level`` (bit i set: the i-th from the
    right is aggregated away), n, total, low, high, the estimated number of keys and quantiles of the value."""
    merged = stored.cube(*dims).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("n_keys"), F.kll_merge_agg_double("ranks").alias("__ranks"),
    )
    some = F.kll_sketch_get_n_double("__ranks") > 0  # groups without a value have no quantiles
    q = [F.when(some, F.kll_sketch_get_quantile_double("__ranks", F.lit(float(x)))).alias(n) for x, n in zip(quantiles, names)]
    return merged.select(*dims, "level", "n", "total", "low", "high", "n_keys", *q)
