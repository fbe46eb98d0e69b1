"""URL judgement by rules and by trees of path templates, in DataFrame functions only.

Paths are cut into segments. Per host, a tree of templates is grown level by
level: a segment becomes a wildcard when it is variable by shape (it has a
digit: ids, dates, hashes; an extension stays) or because it is one of many
rare children of its parent. Sibling branches of one shape are merged
bottom-up, at every level, where their shares of bad labels for the same rest
of a path do not differ by more than chance. A template's
purity is its share of bad labels, smoothed towards its host's and that
towards all hosts'; templates above the limit are rejected.

Every step is an aggregation with partial sums or a join of such sums. Where
rows meet the sums of their host or parent, these are repeated SALTS times and
rows dealt by a hash, so a host or folder with a third of all pages is spread
over as many tasks. Trees are as deep as the paths are. Explicit rules come
first, the longest that fits.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and belongs to the template of that empty host; empty segments
are kept as such; several labels of a page count each; pages without label
count for the shape of trees only; null page ids are judged like others;
repeated rows count each; URLs of any length are taken whole; an empty table
gives no rows; other columns, of whatever name, are ignored. Without labels,
nothing is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.runtime import discard, stored

#: A parent of more than FANOUT children with under ENOUGH pages and labels has a wildcard for those.
FANOUT, ENOUGH = 20, 5
#: Merging: branches less than Z standard errors from their siblings' share. Purity: weights of the host's and of the overall share.
Z, HOST_WEIGHT, ALL_WEIGHT, LIMIT = 1.96, 10.0, 50.0, 0.5
WILD, MERGED = "*", "{}"
#: Tasks that the rows of one host or parent are dealt to.
SALTS = 16
#: Host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """All segments; shapes with digits as wildcards."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit(WILD), F.regexp_extract(s, "[^0-9/](\\.[A-Za-z]{1,5})$|[0-9](\\.[A-Za-z]{1,5})$", 2))).otherwise(s))


def _meet(rows: DataFrame, sums: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Rows joined with sums of their host or parent, dealt by the hash of a column."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"], how).drop("salt")


def templates(urls: DataFrame) -> DataFrame:
    """urls, distinct (host, path, n, labelled, ...), with the template of each path.

    A path goes down the tree while more than FANOUT paths share its branch;
    below that no parent can be wide, and the rest of the path is taken as it is.
    """
    here, columns = ["host", "template"], [*urls.columns, "template"]
    rows = urls.withColumn("s", _segments(F.col("path"))).withColumn("template", F.lit(""))
    child, rest = F.get("s", F.lit(0)), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0)))
    parts, level = [], 0
    while True:
        children = rows.groupBy(*here, child.alias("child")).agg(*(F.sum(c).alias(c) for c in ("n", "labelled")), F.count("*").alias("paths"))
        few = ~F.col("child").startswith(WILD) & (F.greatest("n", "labelled") < ENOUGH)
        nodes = children.groupBy(*here).agg(F.sum("paths").alias("paths"), F.count_if(few).alias("few"))
        wide = _meet(children.where(few).select(*here, "child"), nodes.where(F.col("few") > FANOUT).select(*here), here, "child").withColumn("rare", F.lit(True))
        rows = _meet(rows.withColumn("child", child), nodes.where(F.col("paths") > FANOUT).select(*here, F.lit(True).alias("open")), here, "path", "left")
        rows = _meet(rows, wide, [*here, "child"], "path", "left")
        below = F.concat("template", F.lit("/"), F.when(F.col("rare"), F.lit(WILD)).otherwise(F.col("child")))
        whole = F.concat("template", F.lit("/"), F.array_join("s", "/"))
        rows = stored(rows.select(*urls.columns, F.when(F.col("open"), below).otherwise(whole).alias("template"), F.when(F.col("open"), rest).otherwise(F.array().cast("array<string>")).alias("s")), f"templates-{level}")
        parts.append(rows.where(F.size("s") == 0).select(*columns))
        rows, level = rows.where(F.size("s") > 0), level + 1
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, parts)


def _branches(counts: DataFrame) -> DataFrame:
    """(host, template, labelled, bad, branch): what a template is part of once siblings alike are merged.

    From the deepest level up, the same rest of a path under siblings of one
    shape is pooled where the share of bad labels allows it; pooled labels
    count together at the levels above. Only levels where a parent has
    several children are visited.
    """
    segments = F.split(F.regexp_replace("template", "^/", ""), "/")
    rows = stored(counts.select("host", "template", "labelled", "bad", segments.alias("s"), segments.alias("g")), "branches")
    places = rows.select("host", "s", F.posexplode("s").alias("at", "x"))
    nodes = places.groupBy("host", "at", F.slice("s", F.lit(1), F.col("at")).alias("up")).agg((F.min("x") < F.max("x")).alias("several"))
    for at in sorted((r[0] for r in nodes.where("several").select("at").distinct().collect()), reverse=True):
        x, mine, pool = F.col("s")[at], ["host", "up", "rest", "x"], ["host", "up", "rest", "shape"]
        there = rows.where(F.size("s") > at)
        keyed = there.withColumn("up", F.slice("s", 1, at)).withColumn("rest", F.slice("g", at + 2, F.size("g"))).withColumn("x", x)
        each = keyed.groupBy(*mine).agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).withColumn("shape", F.regexp_replace("x", "[A-Za-z]+", "a"))
        every = each.groupBy(*pool).agg(F.sum("n").alias("every_n"), F.sum("b").alias("every_b"))
        share = F.col("every_b") / F.greatest("every_n", F.lit(1))
        error = F.sqrt(share * (1 - share) / F.greatest("n", F.lit(1)))
        near = _meet(each, every, pool, "x").where((F.col("n") == 0) | (F.abs(F.col("b") / F.greatest("n", F.lit(1)) - share) <= Z * error))
        several = near.groupBy(*pool).agg(F.count("*").alias("k")).where("k > 1").drop("k")
        merged = _meet(near, several, pool, "x").select(*mine, F.concat(F.lit(MERGED), "shape").alias("to"))
        to = F.concat(F.slice("g", 1, at), F.array(F.coalesce("to", "x")), F.col("rest"))
        changed = _meet(keyed, merged, mine, "template", "left").select("host", "template", "labelled", "bad", "s", to.alias("g"))
        new = stored(changed.unionAll(rows.where(F.size("s") <= at)), f"branches-{at}")
        discard(rows)
        rows = new
    return rows.select("host", "template", "labelled", "bad", F.concat(F.lit("/"), F.array_join("g", "/")).alias("branch"))


def judged_templates(counts: DataFrame) -> DataFrame:
    """(host, template, branch, purity) from (host, template, n, labelled, bad), siblings alike merged."""
    rows = _branches(counts)
    pools = rows.groupBy("host", "branch").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    every = counts.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.coalesce(F.sum("labelled"), F.lit(0)), F.lit(1))).alias("all_share"))
    rows = _meet(_meet(rows, pools, ["host", "branch"], "template"), hosts, ["host"], "template").join(F.broadcast(every))
    host_share = (F.col("h_bad") + ALL_WEIGHT * F.col("all_share")) / (F.col("h_labelled") + ALL_WEIGHT)
    return rows.select("host", "template", "branch", ((F.col("b") + HOST_WEIGHT * host_share) / (F.col("n") + HOST_WEIGHT)).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, template, purity, verdict) of each page.

    labels has (host, path, bad) with bad 0 or 1, for any number of pages.
    Paths and labels are summed by (host, path) first; pages meet their
    template by (host, path), and AQE splits a path that most pages share.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    marks = labels.groupBy("host", "path").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = templates(seen.join(marks, ["host", "path"], "left").fillna(0, ["labelled", "bad"]))
    counts = paths.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
    judged = judged_templates(stored(counts, "template-counts"))
    known = _meet(paths.select("host", "path", "template"), judged, ["host", "template"], "path")
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(known, ["host", "path"], "left").withColumn("rule", rule)
    own = F.when(F.col("purity") >= limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.col("branch").alias("template"), "purity", F.coalesce(fixed, own).alias("verdict"))


def query(spark, sf_dir):
    """op7: every page's verdict. A page's label is its document's, whose number ends the path; bad is quality 0."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(\\.html)?/?$", 1)
    ends = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(number != "", number.cast("long")).alias("doc_id"))
    marks = ends.join(labels.where(F.col("quality").isin(0, 1)).select("doc_id", (1 - F.col("quality")).alias("bad")), "doc_id").select("host", "path", "bad")
    return judge(pages, marks)
