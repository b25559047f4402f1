"""Joins on time: the last row before (as-of), and points inside intervals.

Both cut time into slices, so that a key with a large part of all rows is dealt to as many tasks as it
has slices; neither makes pairs that are not checked for time by the join's own bins, and there is no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(column: str | Column) -> Column:
    """Microseconds of a timestamp (of either kind)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, take: dict[str, str], slice_seconds: float = 86_400.0, strict: bool = False) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` (column of right -> name) of the latest row of ``right`` of equal keys
    whose time is at most (``strict``: before) its own; nulls where there is none.

    Rows of both sides are dealt once, by key and slice of time.  Inside a slice the last row of the right
    side runs along; what a slice starts with comes from one row a key and slice.  Of right rows of equal key and
    time the greatest in ``take`` counts.  A null key or time has no partner.
    """
    names = {c: f"__k{i}" for i, c in enumerate(on)}
    width = int(slice_seconds * 1_000_000)
    keys = list(names.values())
    taken = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    l = left.select(*[F.col(c).alias(k) for c, k in names.items()], micros(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    known = F.col(right_at).isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    r = right.where(known).select(*[F.col(c).alias(k) for c, k in names.items()], micros(right_at).alias("__t"), F.lit(2 if strict else 0).alias("__side"), taken.alias("__r"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__slice", F.floor(F.col("__t") / width))
    along = Window.partitionBy(*keys, "__slice").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("__in", F.last("__r", ignorenulls=True).over(along)).where("__l is not null")
    # one row a key and slice, of both sides: what the slices before it end with
    last = F.max(F.when(F.col("__r").isNotNull(), F.struct("__t", "__r"))).alias("__end")
    ends = both.groupBy(*keys, "__slice").agg(last)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "__slice", F.last("__end", ignorenulls=True).over(before)["__r"].alias("__carry"))
    found = inside.join(carry, [*keys, "__slice"], "left").withColumn("__m", F.coalesce("__in", "__carry"))
    return found.select("__l.*", *[F.col("__m")[n].alias(n) for n in take.values()])


#: Bins that an interval covers at most before it goes to a level of wider ones, and how much wider.
MOST_BINS = 8


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, bin_seconds: float = 3_600.0) -> DataFrame:
    """Pairs of points and intervals of equal keys with start <= time < end; columns of both sides, keys once.

    Time is cut into bins.  An interval has a copy in every bin it touches, at the finest level where that is
    at most ``MOST_BINS`` + 1; levels are eight times as wide, one above the other, so long intervals have no more
    copies than short ones.  A point has one row a level that any interval uses.  A pair meets in exactly one
    bin, and its times are checked again.  Names beside the keys must differ.  Nulls and empty intervals have no pairs.
    """
    width = int(bin_seconds * 1_000_000)
    a, b = micros(start), micros(end)
    i = intervals.withColumn("__a", a).withColumn("__b", b).where("__a < __b")
    span = (F.col("__b") - F.col("__a")) / width
    level = F.when(span <= MOST_BINS, 0).otherwise(F.ceil(F.log(F.greatest(span / MOST_BINS, F.lit(1.0))) / F.log(F.lit(float(MOST_BINS))))).cast("int")
    i = i.withColumn("__level", level)
    of = lambda t, lev: F.floor(t / (F.lit(width) * F.pow(F.lit(MOST_BINS), lev)).cast("long"))
    i = i.withColumn("__bin", F.explode(F.sequence(of(F.col("__a"), F.col("__level")), of(F.col("__b") - 1, F.col("__level")))))
    levels = sorted(r["__level"] for r in i.select("__level").distinct().collect())  # the logarithm of the longest interval
    p = points.withColumn("__t", micros(at)).where("__t is not null")
    p = p.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__bin", of(F.col("__t"), F.col("__level")))
    found = p.join(i, [*on, "__level", "__bin"]).where("__a <= __t and __t < __b")
    return found.drop("__level", "__bin", "__t", "__a", "__b")


def sessions(events: DataFrame, by: list[str], at: str, gap: str, delay: str | None = None, value: str | None = None) -> DataFrame:
    """Sessions of every key: start, end (last event plus ``gap``), number of events and the sum of
    ``value``.  Batch and stream alike; a stream takes its watermark from ``delay`` and then drops later rows (``late_rows`` counts them).
    Rows without time are left out."""
    e = events.where(F.col(at).isNotNull())
    if delay is not None:
        e = e.withWatermark(at, delay)
    more = [F.sum(value).alias("total")] if value else []
    s = e.groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), *more)
    return s.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", *(["total"] if value else []))


def late_rows(query) -> int:
    """Rows that a streaming query has dropped because its watermark had passed them."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])


def _slices(rows: DataFrame, by: list[str], at: str, slice_seconds: float) -> DataFrame:
    width = int(slice_seconds * 1_000_000)
    return rows.withColumn("__t", micros(at)).withColumn("__slice", F.floor(F.col("__t") / width)).withColumn("__start", F.col("__slice") * width)


def range_sums(rows: DataFrame, by: list[str], at: str, seconds: float, sums: dict[str, Column], slice_seconds: float = 86_400.0) -> DataFrame:
    """Every row with ``sums`` (name -> exact numeric expression: counts, decimals) over the rows of its key whose time lies in
    [its own - ``seconds``, its own], peers included: a RANGE frame whose keys may be hot.

    A frame is the difference of two prefix sums.  Prefix sums run inside slices of time, each from the total of the
    slices before it; the earlier one is looked up by an as-of join.  Rows without key or time are left out.
    """
    known = F.col(at).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    s = _slices(rows.where(known), by, at, slice_seconds).select("*", *[F.coalesce(e, F.lit(0)).alias(f"__v_{n}") for n, e in sums.items()])
    within = Window.partitionBy(*by, "__slice").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    totals = s.groupBy(*by, "__slice").agg(*[F.sum(f"__v_{n}").alias(f"__b_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "__slice", *[F.coalesce(F.sum(f"__b_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    run = s.select("*", *[F.sum(f"__v_{n}").over(within).alias(f"__p_{n}") for n in sums]).join(base, [*by, "__slice"])
    run = run.select(*rows.columns, "__t", *[(F.col(f"__p_{n}") + F.col(f"__b_{n}")).alias(f"__s_{n}") for n in sums])
    left = run.withColumn("__from", F.timestamp_micros(F.col("__t") - int(seconds * 1_000_000)))
    prefix = run.select(*by, F.timestamp_micros("__t").alias("__at"), *[F.col(f"__s_{n}").alias(f"__o_{n}") for n in sums])
    found = asof_join(left, prefix, by, "__from", "__at", {f"__o_{n}": f"__o_{n}" for n in sums}, slice_seconds, strict=True)
    return found.select(*rows.columns, *[(F.col(f"__s_{n}") - F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in sums])


def decayed_sums(rows: DataFrame, by: list[str], at: str, value: Column, tau_seconds: float, name: str = "popularity", slice_seconds: float = 86_400.0) -> DataFrame:
    """Every row with the sum of ``value`` over the rows of its key up to its time (peers included), each weighed by
    exp(-age / tau).

    Such sums merge: (end, sum) of one slice of time decays to the start of the next.  Inside a slice they are prefix
    sums of values scaled to its start; a key carries one number from slice to slice, so its rows lie in many tasks.
    ``slice_seconds`` over tau is at most 500, else the scaling would overflow.
    """
    if slice_seconds / tau_seconds > 500:
        raise ValueError("slices of more than 500 tau")
    tau = tau_seconds * 1e6
    known = F.col(at).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    s = _slices(rows.where(known), by, at, slice_seconds)
    age = (F.col("__t") - F.col("__start")) / tau
    s = s.withColumn("__grown", F.coalesce(value, F.lit(0.0)).cast("double") * F.exp(age))
    within = Window.partitionBy(*by, "__slice").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # what each slice leaves, decayed to its own start; a key has a row a slice
    left = s.groupBy(*by, "__slice").agg(F.sum("__grown").alias("g"), F.first("__start").alias("start"))
    state = F.array_sort(F.collect_list(F.struct("start", "__slice", "g")))
    step = lambda acc, x: F.struct(
        x["start"].alias("at"), ((acc["sum"] + acc["g"]) * F.exp((acc["at"] - x["start"]) / tau)).alias("sum"), x["g"].alias("g"),
        F.concat(acc["out"], F.array(F.struct(x["__slice"].alias("s"), ((acc["sum"] + acc["g"]) * F.exp((acc["at"] - x["start"]) / tau)).alias("c")))).alias("out"),
    )
    zero = F.struct(F.col("__all")[0]["start"].alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("g"), F.array().cast("array<struct<s:bigint,c:double>>").alias("out"))
    carried = left.groupBy(*by).agg(state.alias("__all")).select(*by, F.explode(F.aggregate("__all", zero, step)["out"]).alias("x"))
    carried = carried.select(*by, F.col("x.s").alias("__slice"), F.col("x.c").alias("__carry"))
    run = s.withColumn("__sum", F.sum("__grown").over(within)).join(carried, [*by, "__slice"])
    return run.select(*rows.columns, ((F.col("__sum") + F.col("__carry")) * F.exp(-age)).alias(name))
