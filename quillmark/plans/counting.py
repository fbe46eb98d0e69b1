"""Counts, cross tables, distributions and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators.ordering import global_position, running_total
from quillmark.plans.registry import query
from quillmark.sources.tables import table


@query("q_label_counts", "select o_orderstatus as label, count(*) as n, count(distinct o_custkey) as n_papers, count(distinct o_orderpriority) as n_kinds from orders group by 1")
def label_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_papers"), F.count_distinct("o_orderpriority").alias("n_kinds"))


@query(
    "q_cond_counts",
    """select count(*) filter (where o_orderstatus = 'F') as reuse, count(*) filter (where o_orderstatus = 'O') as mention, count(*) filter (where o_orderstatus = 'P') as neither,
    count(*) filter (where o_orderstatus = 'F' and o_orderpriority = '1-URGENT') as reuse_direct, count(distinct case when o_orderstatus = 'F' then o_custkey end) as reuse_papers from orders""",
)
def conditional_counts(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(
        F.count_if(s == "F").alias("reuse"),
        F.count_if(s == "O").alias("mention"),
        F.count_if(s == "P").alias("neither"),
        F.count_if((s == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("reuse_direct"),
        F.count_distinct(F.when(s == "F", F.col("o_custkey"))).alias("reuse_papers"),
    )


@query(
    "q_exclusive",
    """with s as (select l_orderkey, list_sort(list(distinct l_returnflag)) as flags from lineitem group by 1)
    select f as archive, count(*) as papers, count(*) filter (where len(flags) = 1) as exclusive from (select flags, unnest(flags) as f from s) group by 1""",
)
def exclusive(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return sets.select("flags", F.explode("flags").alias("archive")).groupBy("archive").agg(F.count("*").alias("papers"), F.count_if(F.size("flags") == 1).alias("exclusive"))


@query(
    "q_mode_partition",
    """with m as (select o_custkey, bool_or(o_orderpriority in ('1-URGENT', '2-HIGH')) as direct, bool_or(o_orderpriority not in ('1-URGENT', '2-HIGH')) as cited from orders group by 1)
    select case when direct and cited then 'both' when direct then 'direct only' else 'citation only' end as mode, count(*) as papers from m group by 1""",
)
def mode_partition(spark, d):
    direct = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    modes = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(direct).alias("direct"), F.bool_or(~direct).alias("cited"))
    mode = F.when(F.col("direct") & F.col("cited"), "both").when(F.col("direct"), "direct only").otherwise("citation only")
    return modes.groupBy(mode.alias("mode")).agg(F.count("*").alias("papers"))


@query(
    "q_top_with_split",
    """select c_nationkey as dataset, count(*) as total, count(*) filter (where c_mktsegment = 'BUILDING') as same_lab, count(*) filter (where c_mktsegment is distinct from 'BUILDING') as different_lab
    from orders join customer on o_custkey = c_custkey group by 1 order by total desc, dataset limit 10""",
)
def top_with_split(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    same = F.col("c_mktsegment").eqNullSafe("BUILDING")
    return joined.groupBy(F.col("c_nationkey").alias("dataset")).agg(F.count("*").alias("total"), F.count_if(same).alias("same_lab"), F.count_if(~same).alias("different_lab")).orderBy(F.desc("total"), "dataset").limit(10)


@query(
    "q_other_bucket",
    """with b as (select p_brand, count(*) as n from part group by 1), k as (select *, row_number() over (order by n desc, p_brand) as r from b)
    select case when r <= 10 then p_brand else 'Other' end as name, sum(n)::bigint as n from k group by 1""",
)
def other_bucket(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "p_brand").limit(10).select("p_brand", F.lit(True).alias("top"))
    name = F.when(F.col("top"), F.col("p_brand")).otherwise("Other")
    return counts.join(F.broadcast(top), "p_brand", "left").groupBy(name.alias("name")).agg(F.sum("n").alias("n"))


@query(
    "q_small_to_other",
    """with b as (select p_type, count(*) as n from part group by 1) select case when n < 40 then 'Other' else p_type end as name, sum(n)::bigint as n from b group by 1""",
)
def small_to_other(spark, d):
    counts = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return counts.groupBy(F.when(F.col("n") < 40, "Other").otherwise(F.col("p_type")).alias("name")).agg(F.sum("n").alias("n"))


@query(
    "q_by_quarter_cum",
    """with q as (select cast(date_trunc('quarter', o_orderdate) as date) as quarter, count(*) as n from orders group by 1)
    select cast(quarter as varchar) as quarter, n, sum(n) over (order by quarter)::bigint as total from q""",
)
def by_quarter_cumulative(spark, d):
    counts = table(spark, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter")).agg(F.count("*").alias("n"))
    return counts.join(running_total(counts, "quarter", "n", "total"), "quarter").withColumn("quarter", F.col("quarter").cast("string"))


@query(
    "q_gap_fill",
    """with f as (select o_custkey, min(o_orderdate) as t from orders group by 1), q as (select cast(date_trunc('month', t) as date) as month, count(*) as n from f group by 1),
    s as (select cast(unnest(generate_series((select min(month) from q)::timestamp, (select max(month) from q)::timestamp, interval 1 month)) as date) as month)
    select cast(s.month as varchar) as month, coalesce(q.n, 0) as n from s left join q using (month)""",
)
def gap_filled(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("t"))
    counts = first.groupBy(F.trunc(F.col("t").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    spine = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return spine.join(counts, "month", "left").select(F.col("month").cast("string").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "q_by_year",
    """select cast(year(o_orderdate) as int) as year, count(*) filter (where o_orderstatus = 'F') as same, count(*) filter (where o_orderstatus <> 'F') as other from orders where year(o_orderdate) between 1996 and 2000 group by 1""",
)
def by_year(spark, d):
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate")).where(F.col("year").between(1996, 2000))
    return rows.groupBy("year").agg(F.count_if(F.col("o_orderstatus") == "F").alias("same"), F.count_if(F.col("o_orderstatus") != "F").alias("other"))


@query(
    "q_delay_groups",
    """with j as (select case when o_orderstatus = 'F' then 'same' when o_orderstatus = 'O' then 'other' else 'mention' end as grp, epoch(l_shipdate) - epoch(o_orderdate) as s from lineitem join orders on l_orderkey = o_orderkey),
    d as (select grp, floor(s / 86400) / 30.44 as m from j)
    select grp, count(*) as n, count(*) filter (where m <= 0) as skipped, round(median(m) filter (where m > 0), 6) as median from d group by 1""",
)
def delay_groups(spark, d):
    from quillmark.functions.scalars import months_between_days

    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    grp = F.when(F.col("o_orderstatus") == "F", "same").when(F.col("o_orderstatus") == "O", "other").otherwise("mention")
    m = j.select(grp.alias("grp"), months_between_days("l_shipdate", "o_orderdate").alias("m"))
    return m.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("m") <= 0).alias("skipped"), F.round(F.median(F.when(F.col("m") > 0, F.col("m"))), 6).alias("median"))


@query(
    "q_describe",
    """select o_orderpriority as grp, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std_sample, round(stddev_pop(o_totalprice), 4) as std_population,
    min(o_totalprice) as least, max(o_totalprice) as most, round(quantile_cont(o_totalprice, 0.25), 6) as q1, round(median(o_totalprice), 6) as q2, round(quantile_cont(o_totalprice, 0.75), 6) as q3 from orders group by 1""",
)
def describe(spark, d):
    x = F.col("o_totalprice")
    quarter = lambda p: F.round(F.percentile(x, F.lit(p)), 6)
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std_sample"), F.round(F.stddev_pop(x), 4).alias("std_population"), F.min(x).alias("least"), F.max(x).alias("most"), quarter(0.25).alias("q1"), quarter(0.5).alias("q2"), quarter(0.75).alias("q3"))


@query(
    "q_nearest_rank",
    """with o as (select o_totalprice as x, row_number() over (order by o_totalprice) - 1 as i, count(*) over () as n from orders)
    select p, max(x) filter (where i = least(cast(floor(n * p) as bigint), n - 1)) as value from o, (values (0.1::double), (0.5::double), (0.9::double)) t(p) group by p""",
)
def nearest_rank(spark, d):
    """The value at place int(n * p), by positions counted over ranges."""
    rows = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"))
    placed = global_position(rows, ["x"], "place").withColumn("i", F.col("place") - 1)
    wanted = rows.agg(F.count("*").alias("n")).select(F.explode(F.array(*(F.lit(p) for p in (0.1, 0.5, 0.9)))).alias("p"), "n")
    wanted = wanted.select("p", F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1).alias("i"))
    return placed.join(F.broadcast(wanted), "i").select("p", F.col("x").alias("value"))


@query(
    "q_hist",
    """with r as (select min(value) as lo, max(value) as hi from events), b as (select least(floor((value - lo) / ((hi - lo) / 20)), 19)::int as bin from events, r)
    select bin, count(*) as n from b group by 1""",
)
def histogram(spark, d):
    """Equal bins, half-open but for the last."""
    ev = table(spark, d, "events")
    r = ev.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / 20
    # one row
    return ev.select("value").join(F.broadcast(r)).groupBy(F.least(F.floor((F.col("value") - F.col("lo")) / w), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("q_count_of_counts", "with c as (select l_suppkey, count(*) as k from lineitem group by 1) select k, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from c group by 1")
def count_of_counts(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(whole)).select("k", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("q_ccdf", "with c as (select l_partkey, count(*) as k from lineitem group by 1), h as (select k, count(*) as n from c group by 1) select k, round(sum(n) over (order by k desc) / sum(n) over (), 6) as p from h")
def upper_tail(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    above = running_total(counts, "k", "n", "m", descending=True)
    return above.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("k", F.round(F.col("m") / F.col("all"), 6).alias("p"))


@query(
    "q_window_counts",
    """with c as (select o_custkey, min(o_orderdate) as created from orders group by 1),
    j as (select c.o_custkey, c.created, count(*) filter (where o.o_orderdate > c.created and epoch(o.o_orderdate) - epoch(c.created) <= 2 * 365.25 * 86400) as n from c left join orders o using (o_custkey) group by all)
    select n, epoch(timestamp '2001-01-01') - epoch(created) >= 2 * 365.25 * 86400 as complete, count(*) as datasets from j group by all""",
)
def windowed_counts(spark, d):
    """Datasets by events in their first two years, and whether those are over."""
    o = table(spark, d, "orders")
    s = lambda x: F.unix_timestamp(F.col(x).cast("timestamp"))
    created = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created"))
    span = 2 * 365.25 * 86400
    n = o.join(created, "o_custkey").groupBy("o_custkey", "created").agg(F.count_if((F.col("o_orderdate") > F.col("created")) & (s("o_orderdate") - s("created") <= span)).alias("n"))
    complete = F.unix_timestamp(F.lit("2001-01-01").cast("timestamp")) - s("created") >= span
    return n.groupBy("n", complete.alias("complete")).agg(F.count("*").alias("datasets"))


@query(
    "q_rollup_by_paper",
    """with p as (select l_orderkey, list_sort(list(distinct l_returnflag)) as labs, list_sort(list(distinct l_linestatus)) as archives, max(l_quantity) as confidence from lineitem group by 1),
    c as (select *, case when len(labs) > 1 then 'mixed' when labs[1] = 'N' then 'same' else 'different' end as lab, case when list_contains(archives, 'O') then 'home' else 'other' end as provenance from p)
    select lab, provenance, count(*) as papers, round(avg(confidence), 6) as confidence from c group by all""",
)
def rollup_by_paper(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("labs"), F.bool_or(F.col("l_linestatus") == "O").alias("home"), F.max("l_quantity").alias("confidence"))
    lab = F.when(F.size("labs") > 1, "mixed").when(F.col("labs")[0] == "N", "same").otherwise("different")
    return p.groupBy(lab.alias("lab"), F.when(F.col("home"), "home").otherwise("other").alias("provenance")).agg(F.count("*").alias("papers"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(
    "q_best_row",
    """select l_suppkey as paper, max(l_quantity) as confidence, count(distinct l_partkey) as datasets, min(l_partkey) filter (where l_quantity = m) as best from (select *, max(l_quantity) over (partition by l_suppkey) as m from lineitem) group by 1""",
)
def best_row(spark, d):
    """The row of the highest confidence of each paper, the least dataset among equals."""
    best = F.min(F.struct(-F.col("l_quantity"), "l_partkey"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("paper")).agg(F.max("l_quantity").alias("confidence"), F.count_distinct("l_partkey").alias("datasets"), best.alias("b"))
    return rows.select("paper", "confidence", "datasets", F.col("b.l_partkey").alias("best"))


@query("q_audit_having", "select l_suppkey as dataset, count(*) as n, round(avg(case when l_returnflag = 'N' then 1 else 0 end), 6) as absent from lineitem group by 1 having count(*) >= 20 and avg(case when l_returnflag = 'N' then 1 else 0 end) > 0.34")
def audit(spark, d):
    absent = F.avg((F.col("l_returnflag") == "N").cast("int"))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("dataset")).agg(F.count("*").alias("n"), F.round(absent, 6).alias("absent"), absent.alias("a")).where("n >= 20 and a > 0.34").drop("a")


@query(
    "q_corr",
    """with c as (select o_custkey, count(*) as n, sum(o_totalprice) as v from orders group by 1) select round(corr(log10(v + 1), n), 6) as pearson, count(*) as n from c""",
)
def correlation(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    return c.agg(F.round(F.corr(F.log10(F.col("v") + 1), F.col("n").cast("double")), 6).alias("pearson"), F.count("*").alias("n"))


@query(
    "q_spearman",
    """with c as (select o_custkey, count(*)::double as x, round(sum(o_totalprice)) as y from orders group by 1),
    r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from c)
    select round(corr(rx, ry), 6) as spearman from r""",
)
def rank_correlation(spark, d):
    """Pearson correlation of average ranks; ranks are running counts by value."""
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("x"), F.round(F.sum("o_totalprice")).alias("y"))
    for v in ("x", "y"):
        sizes = c.groupBy(v).agg(F.count("*").alias("k"))
        upto = running_total(sizes, v, "k", "m").join(sizes, v)
        c = c.join(upto.select(v, (F.col("m") - (F.col("k") - 1) / 2.0).alias(f"r{v}")), v)
    return c.agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"))


@query(
    "q_unclear_alloc",
    """with k as (select c_mktsegment as archive, count(*) as n from customer group by 1), u as (select n from k where archive = 'MACHINERY'), t as (select sum(n) as s from k where archive not in ('MACHINERY', 'BUILDING'))
    select archive, n, round(case when archive = 'BUILDING' then n else n + (select n from u) * n / (select s from t) end, 6) as estimate from k where archive <> 'MACHINERY'""",
)
def unclear_allocated(spark, d):
    """Rows of an unclear archive shared out in proportion, one archive being left as it is."""
    k = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("archive")).agg(F.count("*").alias("n"))
    sums = k.agg(F.sum(F.when(F.col("archive") == "MACHINERY", F.col("n"))).alias("u"), F.sum(F.when(~F.col("archive").isin("MACHINERY", "BUILDING"), F.col("n"))).alias("s"))
    share = F.when(F.col("archive") == "BUILDING", F.col("n").cast("double")).otherwise(F.col("n") + F.col("u") * F.col("n") / F.col("s"))
    return k.join(F.broadcast(sums)).where("archive <> 'MACHINERY'").select("archive", "n", F.round(share, 6).alias("estimate"))


@query(
    "q_cost_model",
    """with c as (select source, length(text) as chars from documents) select source, count(*) as papers, round(avg(chars), 4) as mean, round(median(chars), 4) as median, max(chars)::bigint as most,
    round(sum(chars) / 4.0 / 1e6 * 0.5 + count(*) * 300 / 1e6 * 3.0, 6) as cost from c group by 1""",
)
def cost_model(spark, d):
    """Cost of reading every whole text at four characters a token, with 300 tokens of answer each."""
    chars = table(spark, d, "documents").select("source", F.char_length("text").alias("c"))
    cost = F.sum("c") / 4.0 / 1e6 * 0.5 + F.count("*") * 300 / 1e6 * 3.0
    return chars.groupBy("source").agg(F.count("*").alias("papers"), F.round(F.avg("c"), 4).alias("mean"), F.round(F.median("c"), 4).alias("median"), F.max("c").cast("long").alias("most"), F.round(cost, 6).alias("cost"))


@query(
    "q_crosstab",
    """select o_orderpriority as type, count(*) filter (where o_orderstatus = 'F') as "F", count(*) filter (where o_orderstatus = 'O') as "O", count(*) filter (where o_orderstatus = 'P') as "P" from orders group by 1""",
)
def cross_table(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("type")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query(
    "q_group_stats",
    """select o_custkey as dataset, min(o_orderkey) as first_name, count(*) as n, round(median(o_totalprice), 6) as median from orders group by 1 having count(*) >= 2""",
)
def group_stats(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("dataset")).agg(F.min("o_orderkey").alias("first_name"), F.count("*").alias("n"), F.round(F.median("o_totalprice"), 6).alias("median")).where("n >= 2")


@query("q_dedup_ratio", "select round(count(distinct l_orderkey)::double / count(*), 6) as ratio, count(*) as pairs from lineitem")
def dedup_ratio(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.count_distinct("l_orderkey") / F.count("*"), 6).alias("ratio"), F.count("*").alias("pairs"))


@query(
    "q_top_each",
    """with k as (select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as place from customer) select c_nationkey, c_custkey, c_acctbal, place from k where place <= 3""",
)
def top_of_each(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


@query("q_token_sums", "select event_type as kind, count(*) as n, round(sum(value), 4) as total, round(sum(value) * 0.14 / 1e6, 8) as cost, count(*) filter (where value > 100) as large from events group by 1")
def token_sums(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("value") * 0.14 / 1e6, 8).alias("cost"), F.count_if(F.col("value") > 100).alias("large"))
