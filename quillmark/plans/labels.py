"""Answers of classifiers as labels, texts for them, versions of titles, cleaned ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import mentions as N
from quillmark.functions import scalars as X
from quillmark.operators import labels as L
from quillmark.operators.titles import without_other_versions
from quillmark.plans.registry import query
from quillmark.sources.tables import table


@query(
    "q_usage_labels",
    """with a as (select o_custkey as paper, max({'v': o_orderkey, 'l': case o_orderstatus when 'F' then 'PRIMARY' when 'O' then 'SECONDARY' else 'MAYBE' end}).l as label from orders group by 1)
    select c_mktsegment as part, case when label in ('PRIMARY', 'SECONDARY', 'NEITHER') then label else 'UNKNOWN' end as label, count(*) as n from customer left join a on c_custkey = paper group by 1, 2""",
)
def usage_labels(spark, d):
    """The newest answer on each paper, those outside the vocabulary and missing ones as UNKNOWN."""
    answer = F.expr("case o_orderstatus when 'F' then ' primary' when 'O' then 'SECONDARY' else 'maybe' end")
    answers = table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").alias("version"), answer.alias("label"))
    papers = table(spark, d, "customer").select(F.col("c_custkey").alias("paper"), F.col("c_mktsegment").alias("part"))
    return L.labelled(papers, answers, ["paper"], ["PRIMARY", "SECONDARY", "NEITHER"], "UNKNOWN").groupBy("part", "label").agg(F.count("*").alias("n"))


@query(
    "q_verdicts",
    """with v as (select o_custkey as k, max({'v': o_orderkey, 'l': o_orderstatus}).l as verdict from orders group by 1)
    select c_custkey, c_mktsegment, case when verdict in ('F', 'O') then verdict else 'ERROR' end as label from customer left join v on c_custkey = k where c_mktsegment <> 'BUILDING' or verdict = 'F'""",
)
def verdicts(spark, d):
    """Rows of one origin only with the wanted verdict, all others as they are; an error or none is a no."""
    answers = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("label"))
    rows = L.labelled(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), answers, ["c_custkey"], ["F", "O"], "ERROR")
    return L.approved(rows, "label", "F", F.col("c_mktsegment") == "BUILDING")


_ID = "concat('ds', o_orderkey, case o_orderkey % 4 when 0 then 'Download' when 1 then 'http:' when 2 then 'http:Download' else '' end)"


@query(
    "q_cleaned",
    f"""with i as (select o_orderkey, {_ID} as id, concat(o_clerk, '?!') as q from (select *, concat(o_orderpriority, '–x  ', o_orderstatus) as o_clerk from orders))
    select o_orderkey, regexp_replace(regexp_replace(id, 'Download$', ''), 'http:$', '') as id, trim(regexp_replace(rtrim(replace(replace(q, '–', ' '), '-', ' '), '.,;:!?'), '\\s+', ' ', 'g')) as terms from i""",
)
def cleaned(spark, d):
    """Ids without what links leave at their end, and search terms in their plain form."""
    terms = F.concat("o_orderpriority", F.lit("–x  "), "o_orderstatus", F.lit("?!"))
    return table(spark, d, "orders").select("o_orderkey", X.without_suffixes(F.expr(_ID)).alias("id"), X.search_terms(terms).alias("terms"))


@query(
    "q_prompts",
    """with s as (select n_nationkey, n_name, list(case when s_suppkey % 3 = 0 then '' else s_name end order by s_suppkey) filter (where s_suppkey is not null) as last, list(case when s_suppkey % 2 = 0 then 'A.' end order by s_suppkey) filter (where s_suppkey is not null) as first from nation left join supplier on s_nationkey = n_nationkey group by 1, 2),
    p as (select n_nationkey, n_name, list_filter(list_transform(list_zip(last[1:15], first[1:15]), lambda z: case when z[1] <> '' then trim(concat(z[1], ', ', coalesce(z[2], '')), ', ') end), lambda x: x is not null) as named from s)
    select n_nationkey, concat('Dataset {', n_name, '} by ', case when coalesce(len(named), 0) = 0 then 'Not listed' else array_to_string(named, '; ') end, '.') as prompt from p""",
)
def prompts(spark, d):
    """A question on each dataset, with its contributors' names."""
    s = table(spark, d, "supplier")
    last = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name"))
    person = F.struct(F.col("s_suppkey").alias("at"), last.alias("last"), F.when(F.col("s_suppkey") % 2 == 0, "A.").alias("first"))
    people = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(person)).alias("people"))
    rows = table(spark, d, "nation").join(people, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("n_nationkey", X.filled("Dataset {{{name}}} by {authors}.", name="n_name", authors=X.contributor_names("people")).alias("prompt"))


@query(
    "q_weighted_median",
    "with w as (select l_shipmode, v from (select l_returnflag as l_shipmode, l_linestatus, l_quantity as v from lineitem), range(10) r(i) where l_linestatus = 'F' or i < 3) select l_shipmode as kind, quantile_cont(v, 0.5) as median from w group by 1",
)
def weighted_median(spark, d):
    """The median where rows of one status count for three tenths."""
    rows = table(spark, d, "lineitem").withColumn("sure", F.col("l_linestatus") == "F")
    return rows.groupBy(F.col("l_returnflag").alias("kind")).agg(X.weighted_median("l_quantity", "sure", 0.3, 10).alias("median"))


@query("q_data_sections")
def data_sections(spark, d):
    """What whole texts say of their data, under headings put before some of them."""
    head = F.when(F.col("doc_id") % 3 == 0, "Data availability\n").when(F.col("doc_id") % 3 == 1, "Methods\n").otherwise("we obtained data\n")
    return table(spark, d, "documents").select("doc_id", N.data_sections(F.concat(head, "text")).alias("sections"))


@query("q_title_versions")
def title_versions(spark, d):
    """Benchmark texts and spelt variants of them as titles: preprints go where another version is there."""
    items = table(spark, d, "benchmark")
    plain = items.select((F.col("item_id") * 2).alias("id"), F.col("text").alias("title"), (F.col("item_id") % 2 == 0).alias("preprint"), F.array((F.col("item_id") * 2).alias("x")).alias("datasets"))
    spelt = items.select((F.col("item_id") * 2 + 1).alias("id"), F.regexp_replace("text", "th", "t").alias("title"), (F.col("item_id") % 3 > 0).alias("preprint"), F.array(F.col("item_id") * 2 + 1).alias("datasets"))
    return without_other_versions(plain.union(spelt))
