"""Recurrent events, survival, rates and projections over the table set."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.operators import survival as S
from quillmark.plans.registry import query
from quillmark.sources.tables import table

_EV = """with c as (select user_id, min(ts) as created from events group by 1), cut as (select max(ts) as t from events),
ev as (select e.user_id, round(epoch(e.ts) - epoch(c.created), 0) as t from events e join c using (user_id) where e.event_type = 'purchase' and e.ts > c.created),
ob as (select user_id, round(epoch((select t from cut)) - epoch(created), 0) as t from c)"""


def _histories(spark, d):
    """Purchases by time since a user's first event, and how long each user is observed; in whole seconds."""
    e = table(spark, d, "events")
    s = lambda x: F.unix_micros(F.col(x).cast("timestamp")) / 1e6
    c = e.groupBy("user_id").agg(F.min("ts").alias("created"))
    cut = e.agg(F.max("ts").alias("cut"))
    ev = e.where("event_type = 'purchase'").join(c, "user_id").where("ts > created").select("user_id", F.round(s("ts") - s("created"), 0).alias("t"))
    ob = c.join(F.broadcast(cut)).select("user_id", F.round(s("cut") - s("created"), 0).alias("t"))
    return ev, ob


@query("q_first_event", _EV + " select ob.user_id, coalesce(min(ev.t), ob.t) as t, min(ev.t) is not null as event from ob left join ev on ev.user_id = ob.user_id group by ob.user_id, ob.t")
def first_event(spark, d):
    ev, ob = _histories(spark, d)
    first = ev.groupBy("user_id").agg(F.min("t").alias("f"))
    return ob.join(first, "user_id", "left").select("user_id", F.coalesce("f", "t").alias("t"), F.col("f").isNotNull().alias("event"))


@query(
    "q_km",
    _EV
    + """, f as (select ob.user_id, coalesce(min(ev.t), ob.t) as t, min(ev.t) is not null as event from ob left join ev on ev.user_id = ob.user_id group by ob.user_id, ob.t),
    r as (select t, count(*) filter (where event) as d, count(*) as k from f group by 1), n as (select t, d, sum(k) over (order by t desc) as n from r)
    select t, d::bigint as d, n::bigint as n, round(case when max(case when d >= n then 1 else 0 end) over (order by t) = 1 then 0 else exp(sum(case when d < n then ln(1 - d / n) else 0 end) over (order by t)) end, 6) as survival from n where d > 0""",
)
def kaplan_meier(spark, d):
    return S.kaplan_meier(first_event(spark, d)).withColumn("survival", F.round("survival", 6))


_MCF = (
    _EV
    + """, e as (select t, count(*) as d from ev group by 1), r as (select e.t, e.d, (select count(*) from ob where ob.t >= e.t) as n from e), p as (select * from r where n > 0)
    select t, d, n, round(sum(d / n) over (order by t), 6) as mcf, """
)


@query("q_mcf", _MCF[:-2] + " from p")
def mcf(spark, d):
    return S.cumulative_function(*_histories(spark, d)).select("t", "d", "n", F.round("mcf", 6).alias("mcf"))


@query("q_mcf_ci", _MCF + "round(greatest(sum(d / n) over (order by t) - 1.96 * sqrt(sum(d / (n * n)) over (order by t)), 0), 6) as low, round(sum(d / n) over (order by t) + 1.96 * sqrt(sum(d / (n * n)) over (order by t)), 6) as high from p")
def mcf_interval(spark, d):
    return S.cumulative_function(*_histories(spark, d)).select("t", "d", "n", *(F.round(x, 6).alias(x) for x in ("mcf", "low", "high")))


@query(
    "q_binned_rate",
    _EV
    + """, b as (select unnest(range(10))::int as bin), x as (select bin, sum(greatest(least((bin + 1) * 259200.0, ob.t) - bin * 259200.0, 0)) as exposure from b, ob group by 1), k as (select floor(t / 259200.0)::int as bin, count(*) as events from ev group by 1)
    select bin, coalesce(events, 0) as events, round(exposure, 3) as exposure, round(coalesce(events * 86400 / nullif(exposure, 0), 0), 6) as rate from x left join k using (bin)""",
)
def binned_rate(spark, d):
    """Events a day in bins of three days."""
    ev, ob = _histories(spark, d)
    return S.binned_rates(ev, ob, 259200.0, 10, 86400.0).select("bin", "events", F.round("exposure", 3).alias("exposure"), F.round("rate", 6).alias("rate"))


@query(
    "q_rate_at_risk",
    _EV
    + """, b as (select unnest(range(10))::int as bin), k as (select floor(t / 259200.0)::int as bin, count(*) as events from ev group by 1), n as (select bin, count(*) filter (where ob.t >= bin * 259200.0) as at_risk from b, ob group by 1)
    select bin, coalesce(events, 0) as events, at_risk, round(coalesce(events, 0)::double / greatest(at_risk, 1), 6) as rate from n left join k using (bin)""",
)
def rate_at_risk(spark, d):
    """Events in a bin over the users still observed where it begins."""
    ev, ob = _histories(spark, d)
    b = F.floor(F.col("t") / 259200.0).cast("int")
    k = ev.groupBy(b.alias("bin")).agg(F.count("*").alias("events"))
    stays = ob.select(F.explode(F.sequence(F.lit(0), F.least(b, F.lit(9)))).alias("bin")).groupBy("bin").agg(F.count("*").alias("at_risk"))
    out = spark.range(10).select(F.col("id").cast("int").alias("bin")).join(stays, "bin", "left").join(k, "bin", "left")
    return out.select("bin", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("at_risk", F.lit(0)).alias("at_risk"), F.round(F.coalesce("events", F.lit(0)) / F.greatest(F.coalesce("at_risk", F.lit(0)), F.lit(1)), 6).alias("rate"))


@query(
    "q_intervals",
    _EV
    + """, i as (select ev.user_id, ev.t, 1 as event from ev join ob using (user_id) where ev.t > 0 and ev.t <= ob.t union all select user_id, t, 0 from ob), l as (select *, lag(t, 1, 0) over (partition by user_id order by t, event desc) as start from i)
    select user_id, start, case when t > start then t else start + 0.01 end as stop, event from l where event = 1 or t > start""",
)
def intervals(spark, d):
    return S.counting_process(*_histories(spark, d), "user_id")


@query(
    "q_islands",
    """with e as (select user_id, epoch(ts) as s from events), g as (select *, case when s > lag(s) over (partition by user_id order by s) + 7200 or lag(s) over (partition by user_id order by s) is null then 1 else 0 end as fresh from e),
    i as (select *, sum(fresh) over (partition by user_id order by s rows unbounded preceding) as island from g) select user_id, island::bigint as island, round(min(s), 3) as first, round(max(s), 3) as last, count(*) as n from i group by 1, 2""",
)
def islands(spark, d):
    """Runs of a user's events at most two hours apart."""
    s = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s")
    out = S.islands(table(spark, d, "events").select("user_id", s), ["user_id"], "s", "s", 7200)
    return out.select("user_id", "island", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "n")


@query(
    "q_restart_groups",
    """with m as (select conv_id, turn, length(text) % 17 as num from conversations), f as (select *, case when num <= lag(num) over (partition by conv_id order by turn) then 1 else 0 end as fresh from m)
    select conv_id, turn, num::int as num, sum(fresh) over (partition by conv_id order by turn rows unbounded preceding)::bigint as grp from f""",
)
def restart_groups(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.char_length("text") % 17).alias("num"))
    return S.restarts(rows, ["conv_id"], "turn", "num")


@query(
    "q_nb_moments",
    """with c as (select o_custkey, count(*) as k from orders group by 1), s as (select count(*) as n, sum(k)::double as a, sum(k * k)::double as b from c)
    select n, round(a / n, 6) as mean, round((n * b - a * a) / (n * n), 6) as variance, round(case when n * b - a * a > n * a then a * a / (n * b - a * a - n * a) end, 4) as r, round(case when n * b - a * a > n * a then n * a / (n * b - a * a) end, 6) as p from s""",
)
def nb_moments(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return S.negative_binomial(c, "k").select("n", *(F.round(x, k).alias(x) for x, k in (("mean", 6), ("variance", 6), ("r", 4), ("p", 6))))


@query(
    "q_trend",
    """with q as (select (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) as x, count(*) as y from orders group by 1) select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, greatest(cast(floor(regr_slope(y, x) * 30 + regr_intercept(y, x)) as bigint), 0) as next from q""",
)
def trend(spark, d):
    q = table(spark, d, "orders").groupBy(((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate")).alias("x")).agg(F.count("*").alias("y"))
    slope, at0 = F.regr_slope("y", "x"), F.regr_intercept("y", "x")
    return q.agg(F.round(slope, 6).alias("slope"), F.round(at0, 6).alias("intercept"), F.greatest(F.floor(slope * 30 + at0), F.lit(0)).cast("long").alias("next"))


@query(
    "q_step_lookup",
    """with c as (select o_custkey, count(*) as n, min(o_orderdate) as created from orders group by 1), curve(t, v) as (values (0, 0.0), (100, 0.5), (400, 1.5), (900, 2.25), (1600, 4.0)), a as (select o_custkey, floor((epoch(timestamp '2001-08-01') - epoch(created)) / 86400) as x from c)
    select o_custkey, x::bigint as x, (select v from curve where t <= x order by t desc limit 1)::double as value from a""",
)
def step_lookup(spark, d):
    """The value of a step curve at each dataset's age."""
    from quillmark.functions.scalars import days_between

    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created")).select("o_custkey", days_between(F.lit("2001-08-01").cast("timestamp"), "created").alias("x"))
    curve = spark.createDataFrame([(0, 0.0), (100, 0.5), (400, 1.5), (900, 2.25), (1600, 4.0)], "t long, v double")
    return S.as_of(a, curve)


@query(
    "q_projection",
    """with c as (select min(o_orderdate) as created from orders group by o_custkey), q as (select unnest(generate_series(timestamp '2001-09-30', timestamp '2003-09-30', interval 3 month)) as e),
    curve as (select * from (values (0, 0.0), (100, 0.5), (400, 1.5), (900, 2.25), (1600, 4.0)) x(t, v)), k as (select e, floor((epoch(e) - epoch(created)) / 86400) as age from q join c on created <= e)
    select cast(e::date as varchar) as quarter, count(*) as datasets, round(sum((select max(v) from curve where t <= age))::double, 6) as events from k group by 1""",
)
def projection(spark, d):
    """Expected events at each quarter's end: datasets are counted by creation day, then meet quarters and steps."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("c"))
    days = o.groupBy(F.col("c").cast("timestamp").alias("created")).agg(F.count("*").alias("n"))
    ends = F.explode(F.expr("transform(sequence(0, 8), i -> add_months(date '2001-09-30', 3 * i))"))
    # nine quarters by creation days: both bounded by the calendar
    k = days.select("created", "n", ends.alias("e")).where("created <= e").withColumn("age", F.floor((F.unix_timestamp(F.col("e").cast("timestamp")) - F.unix_timestamp("created")) / 86400))
    value = F.lit(0.0)
    for t, v in ((100, 0.5), (400, 1.5), (900, 2.25), (1600, 4.0)):
        value = F.when(F.col("age") >= t, v).otherwise(value)
    return k.groupBy(F.col("e").cast("string").alias("quarter")).agg(F.sum("n").alias("datasets"), F.round(F.sum(value * F.col("n")), 6).alias("events"))
