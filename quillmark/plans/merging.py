"""Joins, merges, set operations and sinks over the table set."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.operators import merging as M
from quillmark.plans.registry import query
from quillmark.sources.sinks import changed, quarantined, stale, upserted
from quillmark.sources.tables import table

_HALVES = """with r as (select o_custkey as paper, o_orderdate::date as day, min(o_orderstatus) as label, min(o_orderpriority) as pattern, null::varchar as title from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1, 2),
c as (select o_custkey as paper, o_orderdate::date as day, min(o_orderstatus) as label, null::varchar as pattern, case when count(*) > 1 then 'many' end as title from orders where o_orderkey % 2 = 0 group by 1, 2)"""


def _pathways(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumnRenamed("o_custkey", "paper")
    r = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("paper", "day").agg(F.min("o_orderstatus").alias("label"), F.min("o_orderpriority").alias("pattern"), F.lit(None).cast("string").alias("title"))
    c = o.where("o_orderkey % 2 = 0").groupBy("paper", "day").agg(F.min("o_orderstatus").alias("label"), F.lit(None).cast("string").alias("pattern"), F.when(F.count("*") > 1, "many").alias("title"))
    return r, c


@query(
    "q_merge_pathways",
    _HALVES
    + """ select paper, cast(day as varchar) as day, case when c.paper is not null then c.label else r.label end as label, coalesce(c.pattern, r.pattern) as pattern, coalesce(c.title, r.title) as title,
    case when c.paper is not null and r.paper is not null then 'both' when c.paper is not null then 'citation_analysis' else 'direct_reference' end as source_type
    from c full join r using (paper, day) where c.paper is not null or r.label is distinct from 'P'""",
)
def merge_pathways(spark, d):
    r, c = _pathways(spark, d)
    return M.merge_pathways(r, c, ["paper", "day"], "label", "P", ["pattern", "title"]).withColumn("day", F.col("day").cast("string"))


@query(
    "q_merge_upgrade",
    _HALVES
    + """ select paper, cast(day as varchar) as day, case when c.label is null or (r.label = 'F' and c.label <> 'F') then r.label else c.label end as label,
    case when c.label is null then 'direct' when r.label is null then 'citation' when r.label = 'F' and c.label <> 'F' then 'direct' when r.label = c.label then 'both' else 'citation' end as source_type from c full join r using (paper, day)""",
)
def merge_upgrade(spark, d):
    r, c = _pathways(spark, d)
    return M.merge_upgrades(c, r, ["paper", "day"], "label", "F").withColumn("day", F.col("day").cast("string"))


@query("q_antijoin_merge", "select c_custkey as dataset, 'formal' as source, c_nationkey as link from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') union all select o_custkey, 'found', min(o_orderkey) from orders where o_totalprice > 100000 and o_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT') group by 1")
def antijoin_merge(spark, d):
    """Formal links first; found ones only for datasets without."""
    o = table(spark, d, "orders")
    formal = table(spark, d, "customer").join(o.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("dataset"), F.lit("formal").alias("source"), F.col("c_nationkey").cast("long").alias("link"))
    found = o.where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("dataset")).agg(F.lit("found").alias("source"), F.min("o_orderkey").alias("link"))
    return M.fill_where_missing(formal, found, ["dataset"], ["source", "link"], ["source", "link"])


@query(
    "q_preprint_dedup",
    """with v as (select a.doc_id as pre, min(b.doc_id) as pub from documents a join documents b on md5(a.text) = md5(b.text) and b.doc_id < a.doc_id and a.lang = b.lang group by 1)
    select doc_id, lang from documents where doc_id not in (select pre from v)""",
)
def preprint_dedup(spark, d):
    """Later copies stand for preprints, the first of equal texts for the published version; both in one language."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doi"), "doc_id", "lang", F.md5("text").alias("m"))
    first = docs.groupBy("m", "lang").agg(F.min("doc_id").alias("f"))
    versions = docs.join(first, ["m", "lang"]).where("doc_id > f").select(F.col("doi").alias("preprint"), F.col("f").cast("string").alias("published"))
    return M.drop_superseded(docs, versions, "lang").select("doc_id", "lang")


@query(
    "q_version_counts",
    """with e as (select l_partkey - l_partkey % 2 as paper, l_orderkey as citing, min(l_suppkey) as source, bool_or(l_shipdate > timestamp '1998-01-01') as late from lineitem group by 1, 2),
    k as (select *, row_number() over (partition by paper order by source, citing) as place from e)
    select paper, count(*) as total, count(*) filter (where late) as after_creation, count(*) filter (where place <= 50) as capped from k group by 1""",
)
def version_counts(spark, d):
    """Citing papers of both versions of a paper, each once, in all, after a date and within a cap."""
    e = table(spark, d, "lineitem").groupBy((F.col("l_partkey") - F.col("l_partkey") % 2).alias("paper"), F.col("l_orderkey").alias("citing")).agg(F.min("l_suppkey").alias("source"), F.bool_or(F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp_ntz")).alias("late"))
    w = Window.partitionBy("paper").orderBy("source", "citing")
    k = e.withColumn("place", F.row_number().over(w))
    return k.groupBy("paper").agg(F.count("*").alias("total"), F.count_if("late").alias("after_creation"), F.count_if(F.col("place") <= 50).alias("capped"))


@query("q_doc_dedup", "select md5(text) as m, min(doc_id) as doc_id, count(*) as n from documents group by 1")
def doc_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("m")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(
    "q_priority_dedup",
    """select paper, label, orderkey from (select o_custkey as paper, o_orderstatus as label, o_orderkey as orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 else 3 end, o_orderkey) as place from orders) where place = 1""",
)
def priority_dedup(spark, d):
    """The row of the strongest label of each paper, the first among equals."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("orderkey"))
    return M.keep_one(o, ["paper"], [M.priority(F.col("label"), ["F", "O", "P"]), F.col("orderkey")])


@query(
    "q_override",
    """with o(k, rep, rem) as (values (1, ['a', 'b'], null), (3, null, ['standard'])), p as (select s_suppkey, list_sort(list(distinct lower(p_type))) as kinds from supplier join part on p_partkey % 10 = s_suppkey % 10 group by 1)
    select s_suppkey, array_to_string(case when o.rep is not null then o.rep when o.rem is not null then list_filter(kinds, lambda x: not list_contains(o.rem, x)) else kinds end, ',') as kinds from p left join o on o.k = s_suppkey""",
)
def override(spark, d):
    """Lists replaced or cut by a small table of corrections."""
    s, p = table(spark, d, "supplier"), table(spark, d, "part").select((F.col("p_partkey") % 10).alias("m"), F.lower("p_type").alias("t")).distinct()
    items = s.withColumn("m", F.col("s_suppkey") % 10).join(p, "m").groupBy("s_suppkey").agg(F.array_sort(F.collect_set("t")).alias("kinds"))
    o = spark.createDataFrame([(1, ["a", "b"], None), (3, None, ["STANDARD"])], "s_suppkey long, replace array<string>, remove array<string>")
    return M.applied_overrides(items, o, "s_suppkey", "kinds").select("s_suppkey", F.array_join("kinds", ",").alias("kinds"))


@query("q_enrich_nulls", "select d.doc_id, coalesce(nullif(case when d.lang <> 'en' then d.lang else '' end, ''), case when l.quality = 1 then 'good' when l.quality = 0 then 'bad' end) as mark from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)")
def enrich_nulls(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("mark"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.when(F.col("q") == 1, "good").when(F.col("q") == 0, "bad").alias("mark"))
    return M.enriched(docs, labels, "doc_id", ["mark"])


@query("q_semi_anti", "select o_orderstatus as label, count(*) as n, count(*) filter (where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')) as returned from orders group by 1")
def semi_anti(spark, d):
    o = table(spark, d, "orders")
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("r", F.lit(True))
    return o.join(r, "o_orderkey", "left").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"), F.count_if("r").alias("returned"))


@query("q_corpus_difference", "with a as (select distinct l_orderkey as k from lineitem where l_returnflag = 'R'), b as (select distinct l_orderkey as k from lineitem where l_linestatus = 'O') select (select count(*) from (select k from a intersect select k from b)) as in_both, (select count(*) from (select k from a except select k from b)) as dropped, (select count(*) from (select k from b except select k from a)) as new")
def corpus_difference(spark, d):
    x = table(spark, d, "lineitem")
    return M.corpus_difference(x.where("l_returnflag = 'R'"), x.where("l_linestatus = 'O'"), "l_orderkey")


@query("q_set_ops", "select kind, count(*) as n from (select 'intersect' as kind, * from (select o_custkey, o_orderstatus from orders where o_orderpriority = '1-URGENT' intersect select o_custkey, o_orderstatus from orders where o_orderpriority = '5-LOW') union all select 'except', * from (select o_custkey, o_orderstatus from orders where o_orderpriority = '1-URGENT' except select o_custkey, o_orderstatus from orders where o_orderpriority = '5-LOW')) group by 1")
def set_operations(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderpriority") == p).select("o_custkey", "o_orderstatus") for p in ("1-URGENT", "5-LOW"))
    return a.intersect(b).select(F.lit("intersect").alias("kind")).unionAll(a.subtract(b).select(F.lit("except").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "q_union_sources",
    """with u as (select lower(text[1:1]) as k, 'documents' as s from documents where text <> '' union all select lower(role[1:1]), 'conversations' from conversations union all select lower(text[1:1]), 'benchmark' from benchmark where text <> '')
    select k, array_to_string(list_sort(list(distinct s)), ',') as sources, count(*) as n from u group by 1""",
)
def union_sources(spark, d):
    """Union of search sources, with the list of those that found each key."""
    part = lambda t, c: table(spark, d, t).where(F.col(c) != "").select(F.lower(F.left(c, F.lit(1))).alias("k"), F.lit(t).alias("s"))
    u = part("documents", "text").unionAll(part("conversations", "role")).unionAll(part("benchmark", "text"))
    return u.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"), F.count("*").alias("n"))


@query(
    "q_upsert",
    """with cur as (select o_custkey as k, max(o_orderkey) as version, false as bad from orders where o_orderkey % 2 = 0 group by 1), new as (select o_custkey as k, max(o_orderkey) as version, bool_or(o_orderstatus = 'P') as bad from orders where o_orderkey % 2 = 1 group by 1),
    u as (select *, row_number() over (partition by k order by bad, version desc) as place from (select * from cur union all select * from new)) select k, version, bad from u where place = 1""",
)
def upsert(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    cur = o.where("o_orderkey % 2 = 0").groupBy("k").agg(F.max("o_orderkey").alias("version"), F.lit(False).alias("bad"))
    new = o.where("o_orderkey % 2 = 1").groupBy("k").agg(F.max("o_orderkey").alias("version"), F.bool_or(F.col("o_orderstatus") == "P").alias("bad"))
    return upserted(cur, new, ["k"], F.col("bad"), "version")


@query("q_quarantine", "select case when n_chars > 500 then 'usable' else 'excluded' end as side, count(*) as n from documents group by 1")
def quarantine(spark, d):
    good, rest = quarantined(table(spark, d, "documents"), F.col("n_chars") > 500)
    return good.select(F.lit("usable").alias("side")).unionAll(rest.select(F.lit("excluded").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("q_staleness", "select count(*) as to_do from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 0 and l.quality = 1)")
def staleness(spark, d):
    return stale(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], toxic=0, quality=1).agg(F.count("*").alias("to_do"))


@query("q_changed_only", "select count(*) as n from customer c left join (select c_custkey, case when c_custkey % 7 = 0 then 'X' else c_mktsegment end as m from customer where c_custkey % 11 <> 0) p using (c_custkey) where p.c_custkey is null or p.m is distinct from c.c_mktsegment")
def changed_only(spark, d):
    cur = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("m"))
    old = cur.where("c_custkey % 11 <> 0").withColumn("m", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("m")))
    return changed(cur, old, "c_custkey", "m").agg(F.count("*").alias("n"))


@query("q_cascade_delete", "with bad as (select o_custkey, o_orderkey from orders where o_orderstatus = 'P') select 'orders' as t, count(*) as n from orders where o_orderkey not in (select o_orderkey from bad) union all select 'lines', count(*) from lineitem where l_orderkey not in (select o_orderkey from bad) union all select 'customers', count(*) from customer where c_custkey not in (select o_custkey from bad)")
def cascade_delete(spark, d):
    """Rows of three tables left when those of one label go."""
    o = table(spark, d, "orders")
    bad = o.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    left = [
        ("orders", o.join(bad, "o_orderkey", "left_anti")),
        ("lines", table(spark, d, "lineitem").join(bad, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("customers", table(spark, d, "customer").join(bad, F.col("c_custkey") == F.col("o_custkey"), "left_anti")),
    ]
    out = None
    for name, t in left:
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@query(
    "q_word_overlap",
    """with a as (select distinct item_id as title_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) as w from benchmark), b as (select distinct doc_id as name_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) as w from documents),
    a2 as (select * from a where len(w) >= 4), n as (select title_id, count(*) as n from a2 group by 1)
    select title_id, name_id, round(count(*)::double / max(n), 6) as share from a2 join b using (w) join n using (title_id) group by 1, 2 having count(*)::double / max(n) >= 0.5""",
)
def word_overlap(spark, d):
    """Documents that have half of an item's words or more, over whole texts."""
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("title_id"), F.col("text").alias("title"))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("name_id"), F.col("text").alias("name"))
    return M.token_overlap_join(a, b).withColumn("share", F.round("share", 6))


@query("q_two_hop", "select o_custkey as paper, count(distinct l_partkey) as datasets from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey where p_size >= 40 and l_returnflag = 'R' group by 1")
def two_hop(spark, d):
    """Paper to references that pass a filter to the datasets named there."""
    refs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("paper"))
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").where("p_size >= 40").select("p_partkey")
    return refs.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("paper").agg(F.count_distinct("l_partkey").alias("datasets"))


@query("q_first_resolving", "select n_nationkey as dataset, coalesce((select c_acctbal from customer where c_nationkey = n_nationkey and c_acctbal > 5000 order by c_custkey limit 1), 0) as index from nation")
def first_resolving(spark, d):
    """The value of the first linked row that has one, else 0."""
    c = table(spark, d, "customer").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.min_by("c_acctbal", "c_custkey").alias("v"))
    return table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").alias("dataset"), F.coalesce("v", F.lit(0.0)).alias("index"))


@query("q_left_fallback", "select p_brand as archive, count(*) as n, count(*) filter (where s.s_suppkey is null) as unclear from part left join supplier s on p_size = s_suppkey and s_acctbal > 0 group by 1")
def left_fallback(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return table(spark, d, "part").join(s, F.col("p_size") == F.col("s_suppkey"), "left").groupBy(F.col("p_brand").alias("archive")).agg(F.count("*").alias("n"), F.count_if(F.col("s_suppkey").isNull()).alias("unclear"))


@query("q_cap_per_group", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as p from orders) where p <= 2")
def cap_per_group(spark, d):
    return M.capped(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")
