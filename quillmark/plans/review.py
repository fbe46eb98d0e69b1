"""Review of labels, text scalars, JSON, dates and arrays over the table set."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import answers as A
from quillmark.functions import scalars as X
from quillmark.functions.archives import archive_parts, dataset_ids, normal_archive
from quillmark.operators import review as R
from quillmark.plans.registry import query
from quillmark.sources.tables import listed_pages, table

_LABELS = "with l as (select quality::varchar as said, toxic::varchar as found from labels), "


def _pairs(spark, d):
    return table(spark, d, "labels").select(F.col("quality").cast("string").alias("said"), F.col("toxic").cast("string").alias("found"))


@query("q_confusion", "select quality::varchar as said, toxic::varchar as found, count(*) as n from labels where toxic is not null group by all")
def confusion(spark, d):
    return R.confusion(_pairs(spark, d), "said", "found")


@query(
    "q_metrics",
    _LABELS + "k as (select unnest(['0', '1']) as label) select label, (select coalesce(count(*) filter (where found = label)::double / nullif(count(*), 0), 0) from l where said = label) as precision, (select coalesce(count(*) filter (where said = label)::double / nullif(count(*), 0), 0) from l where found = label) as recall, (select count(*) filter (where said = found)::double / count(*) from l) as accuracy from k",
)
def metrics(spark, d):
    return R.label_metrics(R.confusion(_pairs(spark, d), "said", "found"))


@query(
    "q_wald",
    "with s as (select d.lang, count(*) as n, sum(l.quality) as k from labels l join documents d using (doc_id) group by 1) select lang, n, k::bigint as k, round(greatest(k / n - 1.959964 * sqrt(k / n * (1 - k / n) / n), 0), 6) as low, round(least(k / n + 1.959964 * sqrt(k / n * (1 - k / n) / n), 1), 6) as high from s",
)
def wald(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    low, high = R.wald_interval(F.col("k"), F.col("n"))
    return s.select("lang", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "q_transition",
    """with b as (select doc_id, quality::varchar as p, (case when doc_id % 3 = 0 then 1 - quality else quality end)::varchar as c, (case when doc_id % 5 = 0 then toxic else quality end)::varchar as h from labels)
    select h as human, p as parent, c as current, case when p = c then 'same' when c = h then 'fixed' when p = h then 'regressed' else 'drifted' end as outcome, count(*) as n from b group by all""",
)
def transition(spark, d):
    x = table(spark, d, "labels")
    text = lambda e: e.cast("string").alias("label")
    before = x.select("doc_id", text(F.col("quality")))
    after = x.select("doc_id", text(F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))))
    human = x.select("doc_id", text(F.when(F.col("doc_id") % 5 == 0, F.col("toxic")).otherwise(F.col("quality"))))
    return R.transitions(before, after, human, "doc_id")


@query("q_strat_sample", "select quality, doc_id, place from (select quality, doc_id, row_number() over (partition by quality order by md5(doc_id::varchar), doc_id)::int as place from labels) where place between 11 and 30")
def stratified_sample(spark, d):
    return R.stratified_sample(table(spark, d, "labels"), "quality", "doc_id", 20, 10).select("quality", "doc_id", "place")


@query("q_pages", "with r as (select o_orderkey, row_number() over (order by o_orderkey) as p from orders) select (p - 1) // 25 + 1 as page, count(*) as n, min(o_orderkey) as first from r group by 1")
def pages(spark, d):
    """Rows by page of 25 in key order."""
    return listed_pages(table(spark, d, "orders"), 25, "o_orderkey").groupBy("page").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("q_filtered_sorted", "select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'P') and lower(concat_ws(' ', o_orderpriority, o_orderstatus)) like '%urgent%' order by o_totalprice desc, o_orderkey limit 50")
def filtered_sorted(spark, d):
    o = table(spark, d, "orders")
    hit = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).contains("urgent")
    return o.where(F.col("o_orderstatus").isin("F", "P") & hit).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query(
    "q_id_extract",
    """with m as (select distinct page_id, unnest(regexp_extract_all(url, '/(en|fr|de|es)/([0-9]+)', 2)) as id from pages) select id, count(*) as papers from m group by 1""",
)
def id_extract(spark, d):
    """How many pages name each id; ids by the first pattern that finds them."""
    patterns = [(r"/(?:en|fr|de|es)/([0-9]+)", "path"), (r"/([0-9]+)\.html", "file")]
    found = table(spark, d, "pages").select("page_id", F.explode(dataset_ids("url", patterns)).alias("m"))
    return found.groupBy(F.col("m.id").alias("id")).agg(F.count("*").alias("papers"))


@query(
    "q_text_flags",
    """select doc_id, contains(lower(text), 'license') as licensed, length(regexp_replace(text, '[^\n]', '', 'g')) >= 20 as many_lines, regexp_matches(substr(text, cast(floor(length(text) * 0.55) as bigint) + 1), '[0-9]{6}') as number_late from documents""",
)
def text_flags(spark, d):
    late = F.substr("text", F.floor(F.char_length("text") * F.lit(0.55)).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", F.lower("text").contains("license").alias("licensed"), (F.regexp_count("text", F.lit("\n")) >= 20).alias("many_lines"), late.rlike("[0-9]{6}").alias("number_late"))


@query(
    "q_title_norm",
    """select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as title, left(lower(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g'), '-')), 60) as slug, translate('10.1/' || p_brand || ':' || p_size, '/:\\', '___') as file from part""",
)
def title_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normal_title("p_name").alias("title"), X.slug("p_type").alias("slug"), X.file_name(F.concat(F.lit("10.1/"), "p_brand", F.lit(":"), F.col("p_size").cast("string"))).alias("file"))


@query(
    "q_canonical_key",
    """with k as (select doc_id, '10.' || (doc_id % 50)::varchar || '/x' || (doc_id % 7 * 900)::varchar || case when doc_id % 2 = 0 then '.' || (doc_id % 3 + 1)::varchar else '' end || case when doc_id % 5 = 0 then '/v' || (doc_id % 4)::varchar else '' end as doi from documents),
    u as (select doc_id, regexp_replace(doi, '/v[0-9]+$', '') as doi from k), b as (select *, nullif(regexp_extract(doi, '^(.*)\\.[0-9]+$', 1), '') as base from u)
    select doc_id, case when base is not null and (regexp_matches(base, '[0-9]{4,}$') or base in (select doi from u)) then base else doi end as doi from b""",
)
def canonical_key(spark, d):
    """Versions cut off: /vN always, .N where the base is known or ends in four digits."""
    i = F.col("doc_id")
    t = lambda x: x.cast("string")
    doi = F.concat(F.lit("10."), t(i % 50), F.lit("/x"), t(i % 7 * 900), F.when(i % 2 == 0, F.concat(F.lit("."), t(i % 3 + 1))).otherwise(""), F.when(i % 5 == 0, F.concat(F.lit("/v"), t(i % 4))).otherwise(""))
    u = table(spark, d, "documents").select("doc_id", X.unversioned(doi).alias("doi")).withColumn("base", X.dotted_base("doi"))
    known = u.select(F.col("doi").alias("base")).distinct().withColumn("known", F.lit(True))
    return u.join(known, "base", "left").select("doc_id", F.when(F.col("base").isNotNull() & (X.has_accession("base") | F.col("known")), F.col("base")).otherwise(F.col("doi")).alias("doi"))


@query(
    "q_snippet",
    """select doc_id, case when length(text) <= 1000 then text else left(text, 600) || chr(10) || chr(10) || '[... MIDDLE OF PAPER OMITTED FOR LENGTH ...]' || chr(10) || chr(10) || right(text, 400) end as trimmed,
    case when strpos(lower(text), 'license') > 0 or strpos(lower(text), 'reserved') > 0 then substr(text, least(coalesce(nullif(strpos(lower(text), 'license'), 0), 1000000000), coalesce(nullif(strpos(lower(text), 'reserved'), 0), 1000000000)), 100) else '' end as snippet from documents""",
)
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", X.head_and_tail("text", 1000).alias("trimmed"), X.earliest_snippet("text", ["license", "reserved"], 100).alias("snippet"))


@query(
    "q_array_ops",
    """with a as (select l_orderkey as k, list_sort(list(l_partkey)) as v from lineitem group by 1) select k, len(v)::int as n, len(list_distinct(v))::int as kinds, array_to_string(v[1:3], ',') || case when len(v) > 3 then ' +' || (len(v) - 3)::varchar else '' end as top, list_bool_or(list_transform(v, lambda x: x % 10 = 0)) as any_ten, coalesce(list_sum(list_filter(v, lambda x: x % 2 = 0)), 0)::bigint as even from a""",
)
def array_ops(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_partkey")).alias("v"))
    text = F.concat(F.array_join(F.slice("v", 1, 3), ","), F.when(F.size("v") > 3, F.concat(F.lit(" +"), (F.size("v") - 3).cast("string"))).otherwise(""))
    return a.select("k", F.size("v").alias("n"), F.size(F.array_distinct("v")).alias("kinds"), text.alias("top"), F.exists("v", lambda x: x % 10 == 0).alias("any_ten"), F.aggregate(F.filter("v", lambda x: x % 2 == 0), F.lit(0).cast("long"), lambda s, x: s + x).alias("even"))


@query("q_json", "select event_type as kind, count(*) as n, count(*) filter (where json_valid(props) and json_type(props) = 'OBJECT') as objects, count(distinct json_extract_string(props, '$.' || (json_keys(props))[1])) as firsts from events group by 1")
def json_fields(spark, d):
    """Objects among JSON values, and different first fields of them."""
    e = table(spark, d, "events")
    m = F.from_json("props", "map<string, string>")
    first = F.try_element_at(m, F.try_element_at(F.json_object_keys("props"), F.lit(1)))
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull() & F.ltrim("props").startswith("{")).alias("objects"), F.count_distinct(first).alias("firsts"))


@query(
    "q_strict_answers",
    """with a as (select doc_id, case doc_id % 6 when 0 then '{"classification": "reuse"}' when 1 then 'So: {"classification": "MENTION", "confidence": 7} ok' when 2 then '```json' || chr(10) || '{"classification": "NEITHER"}' || chr(10) || '```' when 3 then '{"classification": "LINK"}' when 4 then 'REUSE surely' else '' end as content from documents)
    select doc_id, case doc_id % 6 when 0 then 'REUSE' when 1 then 'MENTION' when 2 then 'NEITHER' end as label, case doc_id % 6 when 3 then 'unrecognized classification' when 4 then 'not a JSON object' when 5 then 'empty response' end as error from a""",
)
def strict_answers(spark, d):
    i = F.col("doc_id") % 6
    content = F.when(i == 0, '{"classification": "reuse"}').when(i == 1, 'So: {"classification": "MENTION", "confidence": 7} ok').when(i == 2, '```json\n{"classification": "NEITHER"}\n```').when(i == 3, '{"classification": "LINK"}').when(i == 4, "REUSE surely").otherwise("")
    return table(spark, d, "documents").select("doc_id", A.strict_answer(content).alias("a")).select("doc_id", "a.label", "a.error")


@query(
    "q_date_rules",
    """select o_orderkey, year(o_orderdate)::varchar || '-Q' || quarter(o_orderdate)::varchar as quarter, cast(last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) as varchar) as quarter_end,
    round(floor((epoch(timestamp '2001-10-07') - epoch(o_orderdate)) / 86400) / 30.44, 6) as months, round(floor((epoch(timestamp '2001-10-07') - epoch(o_orderdate)) / 86400) / 365.25, 6) as years, cast(try_cast(case when o_orderkey % 3 = 0 then 'unknown' else strftime(o_orderdate, '%Y-%m-%d') end as date) as varchar) as day from orders""",
)
def date_rules(spark, d):
    end = F.lit("2001-10-07").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", X.quarter_label("o_orderdate").alias("quarter"), X.quarter_end("o_orderdate").cast("string").alias("quarter_end"), F.round(X.months_between_days(end, "o_orderdate"), 6).alias("months"), F.round(X.years_between_days(end, "o_orderdate"), 6).alias("years"), X.day_or_null(text).cast("string").alias("day"))


@query(
    "q_archive_norm",
    """with c as (select c_custkey, case c_custkey % 6 when 0 then 'crcns' when 1 then 'IBL database' when 2 then 'null' when 3 then 'OSF; Zenodo and GIN' when 4 then 'My Own Site' else 'Neural Latents Benchmark' end as v from customer)
    select c_custkey, case c_custkey % 6 when 0 then 'CRCNS' when 1 then 'IBL' when 2 then null when 3 then 'OSF; Zenodo and GIN' when 4 then 'My Own Site' else 'DANDI Archive' end as name, case c_custkey % 6 when 0 then 'CRCNS' when 1 then 'IBL' when 2 then '' when 3 then 'OSF|Zenodo|GIN' when 4 then 'My Own Site' else 'DANDI Archive' end as parts from c""",
)
def archive_norm(spark, d):
    i = F.col("c_custkey") % 6
    v = F.when(i == 0, "crcns").when(i == 1, "IBL database").when(i == 2, "null").when(i == 3, "OSF; Zenodo and GIN").when(i == 4, "My Own Site").otherwise("Neural Latents Benchmark")
    return table(spark, d, "customer").select("c_custkey", normal_archive(v).alias("name"), F.array_join(archive_parts(v), "|").alias("parts"))
