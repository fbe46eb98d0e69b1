"""Recurrent-event estimates: risk sets, cumulative functions, rates, intervals, projections."""

from __future__ import annotations

from math import erf, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ordering import range_of, running_total, running_totals


#: Widths of a Gaussian kernel within which all of it is that a double can hold.
REACH = 8.5


def risk_sets(events: DataFrame, observed: DataFrame, time: str = "t") -> DataFrame:
    """(t, d, n) by event time: events then, and subjects observed up to then or longer.

    Subjects are added up from the longest observation down, so no event meets
    each subject and no task all rows.
    """
    ends = observed.select(F.col(time).alias("t"), F.lit(1).alias("k"), F.lit(0).alias("d"))
    both = ends.unionAll(events.select(F.col(time).alias("t"), F.lit(0).alias("k"), F.lit(1).alias("d")))
    sums = both.groupBy("t").agg(F.sum("k").alias("k"), F.sum("d").alias("d"))
    at_risk = running_total(sums, "t", "k", "n", descending=True)
    return sums.join(at_risk, "t").where("d > 0 and n > 0").select("t", "d", "n")


def cumulative_function(events: DataFrame, observed: DataFrame, z: float = 1.96) -> DataFrame:
    """(t, d, n, mcf, low, high): the Nelson-Aalen sum of d / n, its variance the sum of d / n^2."""
    risk = risk_sets(events, observed).withColumn("step", F.col("d") / F.col("n")).withColumn("var", F.col("d") / (F.col("n") * F.col("n")))
    out = risk.select("t", "d", "n").join(running_totals(risk, "t", {"mcf": "step", "v": "var"}), "t")
    half = z * F.sqrt("v")
    return out.select("t", "d", "n", "mcf", F.greatest(F.col("mcf") - half, F.lit(0.0)).alias("low"), (F.col("mcf") + half).alias("high"))


def kaplan_meier(first_or_end: DataFrame, time: str = "t", event: str = "event") -> DataFrame:
    """(t, d, n, survival) of subjects with a first event or an end of observation."""
    risk = risk_sets(first_or_end.where(F.col(event)), first_or_end, time)
    # the last factor is 0 when all at risk have the event; its log is kept apart
    factors = risk.withColumn("l", F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)).withColumn("z", (F.col("d") >= F.col("n")).cast("int"))
    return risk.join(running_totals(factors, "t", {"s": "l", "zs": "z"}), "t").select("t", "d", "n", F.when(F.col("zs") > 0, 0.0).otherwise(F.exp("s")).alias("survival"))


def binned_rates(events: DataFrame, observed: DataFrame, width: float, bins: int, per: float = 1.0) -> DataFrame:
    """(bin, events, exposure, rate): events over the time subjects spent in each bin.

    Exposure is summed from the bin that each subject ends in, not from a
    join of bins with subjects.
    """
    b = lambda x: F.floor(F.col(x) / width).cast("int")
    ev = events.withColumn("bin", b("t")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("events"))
    ends = observed.where("t >= 0").withColumn("bin", F.least(b("t"), F.lit(bins))).groupBy("bin").agg(F.count("*").alias("k"), F.sum(F.col("t") - F.col("bin") * width).alias("part"))
    spine = events.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    later = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # one row a bin, and one for those that stay beyond the last
    all_bins = spine.unionAll(events.sparkSession.range(bins, bins + 1).select(F.col("id").cast("int").alias("bin")))
    whole = all_bins.join(F.broadcast(ends), "bin", "left").withColumn("after", F.coalesce(F.sum("k").over(later), F.lit(0)))
    exposure = whole.where(F.col("bin") < bins).select("bin", (F.coalesce("part", F.lit(0.0)) + F.col("after") * width).alias("exposure"))
    out = exposure.join(F.broadcast(ev), "bin", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    return out.select("bin", "events", "exposure", F.coalesce(F.try_divide(F.col("events") * per, F.col("exposure")), F.lit(0.0)).alias("rate"))


def smoothed_rate(events: DataFrame, observed: DataFrame, width: float, places: int = 200, z: float = 1.96) -> DataFrame:
    """(t, rate, low, high) at evenly spaced places up to the longest observation.

    The increments d / n of the cumulative function under a Gaussian kernel,
    over the kernel's part inside the observed span; bounds by the sum of the
    squares of each event's part. An event reaches the places within REACH
    widths, beyond which a double holds nothing of it.
    """
    top = observed.agg(F.max("t")).first()[0]
    if top is None or top <= 0:
        return events.sparkSession.createDataFrame([], "t double, rate double, low double, high double")
    top = float(top)
    step, phi = top / (places - 1), lambda u: 0.5 * (1 + erf(u / sqrt(2)))
    spots = [(i, i * step, max(phi((top - i * step) / width) - phi(-i * step / width), 1e-10)) for i in range(places)]
    grid = events.sparkSession.createDataFrame(spots, "i int, at double, inside double")
    edge = lambda x, f: F.least(F.greatest(f(x / step).cast("int"), F.lit(0)), F.lit(places - 1))
    t = F.col("t").cast("double")
    near = risk_sets(events, observed).select(t.alias("t"), (F.col("d") / F.col("n")).alias("a"), (F.col("d") / (F.col("n") * F.col("n"))).alias("b"), F.explode(F.sequence(edge(t - REACH * width, F.ceil), edge(t + REACH * width, F.floor))).alias("i"))
    weight = F.exp(-0.5 * F.pow((F.col("i") * F.lit(step) - F.col("t")) / width, F.lit(2)))
    sums = near.groupBy("i").agg(F.sum(F.col("a") * weight).alias("a"), F.sum(F.col("b") * weight * weight).alias("b"))
    scale = F.lit(width * sqrt(2 * pi)) * F.col("inside")
    rate, half = F.coalesce(F.col("a"), F.lit(0.0)) / scale, z * F.sqrt(F.coalesce(F.col("b"), F.lit(0.0))) / scale
    return F.broadcast(grid).join(sums, "i", "left").select(F.col("at").alias("t"), rate.alias("rate"), F.greatest(rate - half, F.lit(0.0)).alias("low"), (rate + half).alias("high"))


def negative_binomial(rows: DataFrame, count: str) -> DataFrame:
    """(n, mean, variance, r, p) by moments, over the population; r and p are null unless the variance exceeds the mean.

    All from whole sums, so that a variance equal to the mean is seen as equal.
    """
    k = F.col(count).cast("decimal(18,0)")
    sums = rows.agg(F.count(count).alias("n"), F.sum(k).alias("_a"), F.sum(k * k).alias("_b"))
    n, a, b = (F.col(c).cast("decimal(38,0)") for c in ("n", "_a", "_b"))
    spread, n_a = n * b - a * a, n * a
    over = spread > n_a
    d = lambda x: x.cast("double")
    return sums.select("n", (d(a) / d(n)).alias("mean"), (d(spread) / (d(n) * d(n))).alias("variance"), F.when(over, d(a) * d(a) / d(spread - n_a)).alias("r"), F.when(over, d(n_a) / d(spread)).alias("p"))


def counting_process(events: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, event): an interval up to each event and one to the end of observation."""
    rows = events.select(key, F.col("t"), F.lit(1).alias("event")).join(observed.select(key, F.col("t").alias("end")), key).where("t > 0 and t <= end").select(key, "t", "event")
    all_rows = rows.unionAll(observed.select(key, F.col("t"), F.lit(0).alias("event")))
    w = Window.partitionBy(key).orderBy("t", F.col("event").desc())
    out = all_rows.withColumn("start", F.lag("t", 1, 0.0).over(w))
    return out.where("event = 1 or t > start").select(key, "start", F.when(F.col("t") > F.col("start"), F.col("t")).otherwise(F.col("start") + 0.01).alias("stop"), "event")


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: float | Column) -> DataFrame:
    """(keys, island, first, last, n): runs whose parts are at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) > so_far + gap).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n"))


def restarts(rows: DataFrame, keys: list[str], order: str, number: str) -> DataFrame:
    """Rows with the group they are in, a new one beginning wherever numbers stop rising."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.coalesce((F.col(number) <= F.lag(number).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("_new", fresh).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def as_of(questions: DataFrame, steps: DataFrame, at: str = "x") -> DataFrame:
    """Questions with the value of the last step at or before them.

    Steps are a curve of bounded length, one row a time; they are ranged
    together with the questions and filled forward inside the ranges, the
    last value of each range being carried over to the next.
    """
    both = questions.select(F.col(at).alias("_x"), F.struct(*questions.columns).alias("_q"), F.lit(None).cast("double").alias("_v")).unionAll(
        steps.select(F.col("t").cast("double").alias("_x"), F.lit(None).cast(questions.select(F.struct(*questions.columns).alias("q")).schema["q"].dataType).alias("_q"), F.col("v").cast("double").alias("_v"))
    )
    rows = both.withColumn("_p", range_of(both, F.col("_x")))
    order = [F.col("_x"), F.col("_v").isNull()]
    own = F.last("_v", True).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where("_v is not null").groupBy("_p").agg(F.max_by("_v", "_x").alias("_e"))
    parts = rows.select("_p").distinct().join(ends, "_p", "left")
    carried = parts.select("_p", F.last("_e", True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    filled = rows.withColumn("_own", own).join(F.broadcast(carried), "_p", "left")
    return filled.where("_q is not null").select("_q.*", F.coalesce("_own", "_c").alias("value"))
