"""Searches, citation scans, filters and answer fields over the table set."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import answers as A
from quillmark.functions import predicates as P
from quillmark.functions import scalars as X
from quillmark.operators import search as S
from quillmark.plans.registry import query
from quillmark.sources.tables import table


@query("q_search", "select min(url) as doi from pages where coalesce(url, '') <> '' and (contains(lower(html), 'data') or contains(lower(html), 'href=\"/fr')) and not contains(lower(html), 'zzz') group by lower(url)")
def search(spark, d):
    """Pages that a query of wanted and unwanted terms finds, each address once."""
    papers = table(spark, d, "pages").select(F.col("url").alias("doi"), F.col("html").alias("text"))
    return S.search(papers, "text", ["data", 'href="/FR'], ["zzz"]).select("doi")


_TERMS = ("dataset", "the", "der", "les", "que")


@query("q_by_term", "with t as (select concat(source, '-', lang) as doi, case " + " ".join(f"when contains(lower(text), '{t}') then '{t}'" for t in _TERMS) + " end as term from documents) select doi, min(term) as term from t where term is not null and doi is not null group by doi")
def by_term(spark, d):
    """The first term that finds a text of each source and language."""
    papers = table(spark, d, "documents").where("source is not null and lang is not null").select(F.concat_ws("-", "source", "lang").alias("doi"), "text")
    return S.by_term(papers, "text", list(_TERMS)).select("doi", "term")


@query(
    "q_citing_after",
    """with w as (select o_orderkey, o_orderdate from orders where o_orderstatus <> 'P'), e as (select l_suppkey as dataset_id, o_orderdate as day, date '1995-01-01' + cast(l_suppkey % 400 as integer) as made from lineitem left join w on l_orderkey = o_orderkey)
    select dataset_id, count(*) filter (where day > made) as later, count(*) filter (where day >= made or day is null) as later_or_undated from e group by 1 having count(*) filter (where day >= made or day is null) > 0""",
)
def citing_after(spark, d):
    """Works that cite a dataset after it was made, by both rules of dates."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), F.col("l_suppkey").alias("dataset_id"))
    works = table(spark, d, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("doi"), F.col("o_orderdate").cast("date").alias("day"))
    created = edges.select("dataset_id").distinct().withColumn("made", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("dataset_id") % 400).cast("int")))
    loose = S.citing_after(edges, works, created, inclusive=True, keep_undated=True)
    return loose.groupBy("dataset_id").agg(F.count_if(F.col("day") > F.col("made")).alias("later"), F.count("*").alias("later_or_undated"))


_LABEL = "case o_orderstatus when 'F' then 'REUSE' when 'O' then 'MENTION' else 'PRIMARY' end"


@query(
    "q_confidence_rules",
    f"""with o as (select o_orderkey, {_LABEL} as label, cast(o_custkey % 11 as integer) as conf, cast(floor(o_totalprice) as integer) as len, o_orderstatus, o_orderpriority from orders),
    c as (select *, case when label = 'REUSE' and len < 150000 then least(conf, 5) else conf end as confidence from o)
    select o_orderkey, confidence, label = 'REUSE' and len < 150000 as low_text, label = 'REUSE' and confidence >= 7 as high, (o_orderstatus = 'F' or o_orderpriority = '1-URGENT') and len >= 50000 as full_text, case when len >= 50000 then 'classifiable' else 'excluded' end as part from c""",
)
def confidence_rules(spark, d):
    """Confidence capped for short texts, texts that count as full, and where rows go by that."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.expr(_LABEL).alias("label"), (F.col("o_custkey") % 11).cast("int").alias("conf"), F.floor("o_totalprice").cast("int").alias("len"))
    r = rows.withColumn("r", A.capped_confidence("label", "conf", "len", 150_000))
    full = P.has_full_text(F.concat_ws("+", "o_orderstatus", "o_orderpriority"), "len", ["F", "1-URGENT"], 50_000)
    return r.select("o_orderkey", "r.confidence", F.col("r.low_text_warning").alias("low_text"), F.col("r.high_confidence_reuse").alias("high"), full.alias("full_text"), F.when(F.col("len") >= 50_000, "classifiable").otherwise("excluded").alias("part"))


@query(
    "q_answer_fields",
    f"""select o_orderkey, case o_orderpriority when '1-URGENT' then 8 when '2-HIGH' then 5 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 7 else 5 end::int as confidence,
    case o_orderstatus when 'F' then 'true' when 'O' then 'false' else 'none' end as flag, case when o_custkey % 3 = 0 then 'TOOL_DEMO' else 'OTHER' end as kind, case when o_custkey % 3 = 0 then null when o_custkey % 3 = 1 then 'own words' else 'Odd use' end as write_in,
    case when {_LABEL} = 'REUSE' then o_orderpriority end as only_reuse, case when o_custkey % 2 = 0 then 'neurophysiology, imaging' else '' end as modalities from orders""",
)
def answer_fields(spark, d):
    """Fields of answers in their normal form: confidence words, booleans, kinds of reuse, modalities."""
    m = F.col("o_custkey") % 3
    word = F.expr("case o_orderpriority when '1-URGENT' then ' High' when '2-HIGH' then 'medium' when '3-MEDIUM' then 'LOW' when '4-NOT SPECIFIED' then '7' else 'odd' end")
    kind = A.reuse_type(F.when(m == 0, "tool demo").otherwise("Odd use"), F.when(m == 1, " own words "))
    found = A.modalities(F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("EPhys"), F.lit("electrophysiology"), F.lit("zzz"), F.lit("MRI"))).otherwise(F.array().cast("array<string>")))
    rows = table(spark, d, "orders").select("*", kind.alias("k"))
    flag = A.strict_boolean(F.expr("case o_orderstatus when 'F' then 'Yes' when 'O' then '' end"))
    return rows.select("o_orderkey", A.confidence_number(word).alias("confidence"), F.coalesce(flag.cast("string"), F.lit("none")).alias("flag"), F.col("k.type").alias("kind"), F.col("k.write_in").alias("write_in"), A.only_for_reuse(F.expr(_LABEL), "o_orderpriority").alias("only_reuse"), F.array_join(found, ", ").alias("modalities"))


_DOI = """case o_orderkey % 7 when 0 then '10.1101/2021.01.' || o_orderkey when 1 then '10.1038/s41597-' || o_orderkey when 2 then '10.7554/eLife.1.sa1' when 3 then '10.1/peer-review/2' when 4 then '10.48550/arXiv.' || o_orderkey else '10.1016/j.' || o_orderkey end"""


@query(
    "q_doi_kinds",
    f"""with o as (select o_orderkey, o_orderstatus, {_DOI} as doi from orders) select o_orderkey, doi, o_orderkey % 7 in (0, 4) as preprint, case when o_orderkey % 7 = 1 then 'Scientific Data (Nature)' end as descriptor, o_orderkey % 7 in (2, 3) as non_research,
    case when o_orderkey % 7 = 0 and o_orderstatus = 'F' then 'bioRxiv' when o_orderstatus = 'F' then 'openRxiv' else 'Neuron' end as journal from o""",
)
def doi_kinds(spark, d):
    """Preprints, data descriptors and parts of reviews by DOI, and journals repaired by it."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_DOI).alias("doi"), F.when(F.col("o_orderstatus") == "F", "openRxiv").otherwise("Neuron").alias("j"))
    return rows.select("o_orderkey", "doi", X.is_preprint("doi").alias("preprint"), X.descriptor_journal("doi").alias("descriptor"), X.is_non_research("doi").alias("non_research"), X.journal_repaired("doi", "j").alias("journal"))


@query(
    "q_text_forms",
    """with a as (select c_nationkey, list(c_name order by c_custkey) as names, count(*) as n, count(*) filter (where c_acctbal > 0) as k from customer group by 1)
    select c_nationkey, case when len(names) = 1 then names[1] || ', 2020' when len(names) = 2 then names[1] || ' and ' || names[2] || ', 2020' else names[1] || ' et al., 2020' end as cited, array_to_string(names[1:3], ', ') || case when len(names) > 3 then ' +' || (len(names) - 3) else '' end as listed,
    case c_nationkey when 1 then 'one' when 2 then 'two' else 'many' end as named, '2020' || case when c_nationkey % 3 = 0 then '' when c_nationkey % 3 = 1 then '-07' else '-07-05' end as day, k > 0 as some from a""",
)
def text_forms(spark, d):
    """Names cited by how many there are, shortened lists, lookups with a default, dates as far as they are known."""
    a = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("s"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    a = a.withColumn("names", F.transform("s", lambda x: x["c_name"]))
    month, day = F.when(F.col("c_nationkey") % 3 > 0, 7), F.when(F.col("c_nationkey") % 3 == 2, 5)
    named = X.mapped(F.col("c_nationkey").cast("string"), {"1": "one", "2": "two"}, F.lit("many"))
    return a.select("c_nationkey", X.citation_name("names", F.lit(2020)).alias("cited"), X.overflow_list("names", 3).alias("listed"), named.alias("named"), X.padded_date(F.lit(2020), month, day).alias("day"), (F.col("k") > 0).alias("some"))
