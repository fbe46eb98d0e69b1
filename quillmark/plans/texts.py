"""Spans, contexts, quotes and fits: operators that need Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import bibliography as B
from quillmark.functions import mentions as N
from quillmark.functions import quotes as Q
from quillmark.operators import models as O
from quillmark.operators import survival as S
from quillmark.plans.registry import query
from quillmark.plans.survival import _histories
from quillmark.sources.session import ship
from quillmark.sources.tables import table


@query(
    "q_mentions",
    """with m as (select page_id, unnest(regexp_extract_all(html, '<a href="/([A-Za-z]+)">', 1)) as id from pages) select page_id, count(*) as n, count(distinct id) as ids from m group by 1""",
)
def mentions(spark, d):
    """Spans of ids in pages and how many there are."""
    ship(spark)
    spans = N.mention_spans(F.col("html"), [(r'<a href="/([A-Za-z]+)">', "link")])
    found = table(spark, d, "pages").select("page_id", F.explode(spans).alias("m"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("m.id").alias("ids"))


@query("q_mention_islands")
def mention_islands(spark, d):
    """Mentions of one id at most 200 characters apart as one, with the words around."""
    ship(spark)
    spans = N.mention_spans(F.col("text"), [(r"\b(the)\b", "word")])
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(spans).alias("m")).select("doc_id", F.lower("m.id").alias("id"), "m.start", "m.end")
    return S.islands(found, ["doc_id", "id"], "start", "end", 200)


@query("q_quotes", "select doc_id, case when text = '' then 'not_found' else 'exact' end as as_is, 'not_found' as invented from documents where text is not null")
def quotes(spark, d):
    """How a quote from the middle of each text is found, and one that is invented."""
    ship(spark)
    docs = table(spark, d, "documents").where("text is not null")
    middle = F.substring(F.col("text"), F.floor(F.char_length("text") / 2).cast("int") + 1, F.lit(40))
    found = Q.verified_quotes(F.array(middle, F.lit("no such words 987654321")), F.col("text"))
    m = docs.select("doc_id", found.alias("q"))
    return m.select("doc_id", *(F.col("q")[i]["match_type"].alias(n) for i, n in enumerate(("as_is", "invented"))))


@query("q_quotes_whole")
def quotes_whole(spark, d):
    """How quotes from the beginning, middle and end of every text are found, in all languages.

    Each is taken as it is, in capitals, and with its blanks and its ASCII
    punctuation taken out; a quote is null where nothing is left of it.
    """
    ship(spark)
    docs = table(spark, d, "documents").where("text is not null")
    n = F.char_length("text")
    at = F.array(F.lit(1), F.floor(n / 2).cast("int") + 1, F.greatest(n - 39, F.lit(1)))
    views = [lambda q: q, F.upper, lambda q: F.regexp_replace(q, r"\s+", ""), lambda q: F.regexp_replace(q, r"\p{Punct}+", "")]
    quotes = F.flatten(F.transform(at, lambda p: F.array(*(F.nullif(v(F.substring(F.col("text"), p, F.lit(40))), F.lit("")) for v in views))))
    found = Q.verified_quotes(quotes, F.col("text"))
    m = docs.select("doc_id", F.posexplode(found).alias("place", "q"))
    return m.select("doc_id", "place", "q.quote", "q.match_type", "q.offset")


@query("q_contexts")
def contexts(spark, d):
    """Citations of one paper in texts with a bibliography added, and their contexts."""
    ship(spark)
    refs = "\nReferences\n1. Adams A. First of the works on this. 10.1000/aaa\n2. Brown B. Second of the works on that. 10.1000/bbb\n"
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("We follow Brown et al., 2019 and others [1,2]. "), "text", F.lit(refs)).alias("t"))
    found = N.contexts(F.col("t"), F.lit("10.1000/bbb"), F.lit("Second of the works on that"), F.array(F.lit("Brown"), F.lit("Cole"), F.lit("Dunn")), F.lit(2019))
    return docs.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.method", "c.reference_number", "c.citation_position", F.char_length("c.context").alias("chars"))


@query("q_body_citations")
def body_citations(spark, d):
    """From a mention in a bibliography to the contexts in the body that cite its entry."""
    ship(spark)
    tail = "\nReferences\n1. Adams A. First work. 2. Brown B. Data set ABC 000130. 2020. 3. Cole C. Third work."
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("Recordings [1-2] were used. "), "text", F.lit(tail)).alias("t"))
    found = B.body_contexts(F.col("t"), F.locate("ABC 000130", F.col("t")) - 1, F.lit("ABC 000130"), 20)
    return docs.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.reference_number", "c.start", "c.end")


def _in_days(spark, d):
    day = lambda x: x.withColumn("t", F.col("t") / 86400)
    return tuple(map(day, _histories(spark, d)))


@query("q_kernel_rate")
def kernel_rate(spark, d):
    """Smoothed purchases a day with bounds, at 200 places."""
    return S.smoothed_rate(*_in_days(spark, d), 2.0)


@query("q_mcf_bootstrap")
def mcf_bootstrap(spark, d):
    """Bounds of the cumulative function by drawing users and delays again, at 100 places; times in whole days."""
    ship(spark)
    days = [x.groupBy(F.ceil("t").cast("long").alias("t")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, x in enumerate(_in_days(spark, d))]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ev, ob = ((g.t[g.kind == k].to_numpy(float), g.n[g.kind == k].to_numpy()) for k in (0, 1))
        at = np.linspace(0, ev[0].max(initial=0), 100)
        low, high = O.bootstrap_curve(ev, ob, at) if len(ev[0]) else (at, at)
        return pd.DataFrame({"t": at, "low": low, "high": high})

    # one row a day of observation
    return days[0].unionAll(days[1]).withColumn("all", F.col("n") > 0).groupBy("all").applyInPandas(run, "t double, low double, high double")


def _daily(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("2023-12-31").cast("date")).alias("t")).agg(F.count("*").alias("n"))


@query("q_curve_fits")
def curve_fits(spark, d):
    """The best curve for the growth of each kind of event."""
    curve = _daily(spark, d).withColumn("v", F.sum("n").over(Window.partitionBy("event_type").orderBy("t")))
    return O.fitted(curve, "event_type", "t", "v")


@query("q_growth_fits")
def growth_fits(spark, d):
    """The best of power law, logistic and Richards curve for the number of events of each kind, in years."""
    curve = _daily(spark, d).select("event_type", (F.col("t") / 365.25).alias("t"), F.sum("n").over(Window.partitionBy("event_type").orderBy("t")).alias("v"))
    return O.fitted(curve, "event_type", "t", "v", growth=True)


_PER_CUSTOMER = "with c as (select c_nationkey, c_custkey, count(o_orderkey)::double as k from customer left join orders on c_custkey = o_custkey group by all)"


def _orders_a_customer(spark, d):
    """How many customers of a nation have how many orders."""
    o = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return o.groupBy("c_nationkey", "c_custkey").agg(F.count("o_orderkey").alias("k")).groupBy("c_nationkey", "k").agg(F.count("*").alias("n"))


COUNT_FITS = ("mean", "variance", "alpha", "dispersion_t", "poisson_bic", "poisson_zeros", "r", "p", "nb_bic", "nb_zeros", "lrt", "lrt_p")


@query(
    "q_count_fits",
    _PER_CUSTOMER
    + """, s as (select c_nationkey, count(*) as n, avg(k) as m, (count(*) * sum(k * k) - sum(k) * sum(k)) / (count(*) * count(*)) as v, count(*) * sum(k * k) - sum(k) * sum(k) > count(*) * sum(k) as over from c group by 1 having sum(k) > 0),
    a as (select c_nationkey, n, m, v, over, k, ((k - m) * (k - m) - k) / m as aux, k * ln(m) - m - lgamma(k + 1) as lp, case when over then m * m / (v - m) end as r, case when over then m / v end as p from c join s using (c_nationkey)),
    f as (select c_nationkey, n, m, v, r, p, avg(aux) as x, stddev_pop(aux) as sd, sum(lp) as lp, sum(case when over then lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(p) + k * ln(1 - p) end) as nb from a group by all)
    select c_nationkey as nation, round(m, 6) as mean, round(v, 6) as variance, round(x / m, 6) as alpha, round(case when sd > 1e-9 then x / (sd / sqrt(n)) end, 4) as dispersion_t, round(-2 * lp + ln(n), 4) as poisson_bic, round(n * exp(-m), 4) as poisson_zeros, round(r, 4) as r, round(p, 6) as p,
    round(-2 * nb + 2 * ln(n), 4) as nb_bic, round(n * power(p, r), 4) as nb_zeros, round(2 * (nb - lp), 4) as lrt from f""",
)
def count_fits(spark, d):
    """Poisson and negative binomial fits of orders a customer, by nation."""
    ship(spark)
    names = [x for x in COUNT_FITS if x != "lrt_p"]
    digits = {"mean": 6, "variance": 6, "alpha": 6, "p": 6}

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        f = O.count_fits(dict(zip(g.k, g.n)))
        return pd.DataFrame([{"nation": key[0], **{c: f.get(c) for c in names}}]) if f["mean"] else pd.DataFrame({"nation": [], **{c: [] for c in names}})

    found = _orders_a_customer(spark, d).groupBy("c_nationkey").applyInPandas(run, "nation int, " + ", ".join(f"{c} double" for c in names))
    return found.select("nation", *(F.round(F.nanvl(c, F.lit(None)), digits.get(c, 4)).alias(c) for c in names))


@query("q_nb_bootstrap")
def nb_bootstrap(spark, d):
    """Bounds of the negative binomial's mean and r by drawing customers again, by nation."""
    ship(spark)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        b = O.bootstrap_nb(dict(zip(g.k, g.n)))
        return pd.DataFrame([(key[0], *b["mean"], *b["r"])], columns=["nation", "mean_low", "mean_high", "r_low", "r_high"])

    return _orders_a_customer(spark, d).groupBy("c_nationkey").applyInPandas(run, "nation int, mean_low double, mean_high double, r_low double, r_high double")


@query("q_recurrent_regression")
def recurrent_regression(spark, d):
    """Hazard ratios of purchases by covariates of users; a group of users is one task, in time n log n."""
    ship(spark)
    ev, ob = _histories(spark, d)
    day = lambda x: x.withColumn("t", F.col("t") / 86400)
    rows = S.counting_process(day(ev), day(ob), "user_id").withColumn("x1", (F.col("user_id") % 2).cast("double")).withColumn("x2", F.log10(F.col("user_id") + 1.0))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        f = O.cox(g.start.to_numpy(), g["stop"].to_numpy(), g.event.to_numpy(), g[["x1", "x2"]].to_numpy())
        return pd.DataFrame({"grp": key[0], "covariate": ["x1", "x2"], "coef": f["coef"], "hazard_ratio": f["hazard_ratio"], "se": f["se"], "p": f["p"], "concordance": f["concordance"]})

    return rows.withColumn("grp", F.col("user_id") % 5).groupBy("grp").applyInPandas(run, "grp long, covariate string, coef double, hazard_ratio double, se double, p double, concordance double")


@query("q_poisson_bounds")
def poisson_bounds(spark, d):
    """Exact bounds of the rate of purchases a day, by day."""
    ship(spark)
    n = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))

    @F.pandas_udf("struct<low: double, high: double>")
    def bounds(k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([O.poisson_interval(int(x)) for x in k], columns=["low", "high"])

    # once a different count, of which there are far fewer than days and groups
    found = n.select("n").distinct().withColumn("b", bounds("n"))
    return n.join(found, "n").select("day", "n", "b.low", "b.high")
