"""Language model, language identification and URL templates."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute_kn import scores

from quillmark.llm import kneser_ney as kn
from quillmark.llm import language_id as L
from quillmark.llm import lm_scoring as M
from quillmark.llm import textops as tx
from quillmark.llm import url_templates as U


@pytest.mark.parametrize("shard_bytes", [1 << 24, 3000])
def test_scores(spark, data, shard_bytes):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(80)
    extra = spark.createDataFrame([(5000, None), (5001, ""), (5002, "The the THE"), (5003, "unseen wörds \x1c here")], "doc_id long, text string")
    docs = spark.createDataFrame(docs.unionAll(extra).collect(), docs.schema)
    want = scores([(r[0], r[1] if isinstance(r[1], str) else None) for r in docs.collect()])
    from pyspark.sql import functions as F

    model = M.train(docs.where(M.in_training(F.col("doc_id"))), shard_bytes=shard_bytes)
    got = M.score(docs, model).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], model.total) == w[1:4]
        assert r["base_score"] == pytest.approx(w[4], abs=1e-8) and r["score"] == pytest.approx(w[5], abs=1e-8)


def test_scores_of_odd_tables(spark):
    """Ids as text, names that clash, a text of over a megabyte, repeated rows, one hot pair of words."""
    rows = [(f"d{i}", f"of the w{i % 5} of the w{i}", "x") for i in range(40)] + [("long", "word by word and so on " * 60_000, "y"), ("d1", "of the w1 of the w1", "x"), (None, "never learned", None), ("e", "", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string, SCORE string").repartition(3)
    from pyspark.sql import functions as F

    model = M.train(df.where(M.in_training(F.col("doc_id"))), shard_bytes=20_000)
    out = M.score(df, model)
    assert out.columns == ["doc_id", "text", "n_tokens", "n_known", "base_score", "score"]
    want = scores([(f"{i}", t) if i is None else (i, t) for i, t, _ in rows if i is not None])
    for r in out.where("doc_id is not null").collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][5], rel=1e-9) and (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][1:3]


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", 3), (2, None, 4)], "doc_id long, text string, v int")
    got = M.score(df, M.train(df.limit(0))).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


def test_blobs():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    k, n = kn.merged(np.concatenate([keys, keys[:100]]))
    assert (kn.unpack_sorted(kn.pack_sorted(k)) == k).all() and (kn.unpack_counts(kn.pack_counts(n)) == n).all()
    assert n.sum() == 1100 and len(k) == len(set(keys.tolist()))
    assert kn.unpack_sorted(kn.pack_sorted(k[:0])).size == 0


def brute_phrases(text, learned):
    """Greedy longest matches of a symbol sequence in another."""
    i = n = 0
    while i < len(text):
        k = i
        while k < len(text) and any(learned[s : s + k + 1 - i] == text[i : k + 1] for s in range(len(learned))):
            k += 1
        i, n = max(k, i + 1), n + 1
    return n


@pytest.mark.parametrize("lane", [1, 3, 7, 2048])
def test_cross_parsing(monkeypatch, lane):
    """Whole texts of any number of lanes are parsed as one."""
    monkeypatch.setattr(L, "LANE", lane)
    rng = random.Random(2)
    for _ in range(30):
        learned = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))) for _ in range(3)]
        model = L.Languages({str(k): [x] for k, x in enumerate(learned)}, {str(k): 999 for k in range(3)})
        texts = ["".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60))) for _ in range(5)]
        c = next(tx.chunks(pa.array(texts)))
        got = model._costs(*L.symbols(c.data, c.offsets))
        assert got.tolist() == [[pytest.approx(brute_phrases(x, y) / max(1, len(x))) for y in learned] for x in texts]


def longest_matches(text, learned):
    i = n = 0
    while i < len(text):
        k = i + 1
        while k <= len(text) and text[i:k] in learned:
            k += 1
        i, n = max(k - 1, i + 1), n + 1
    return n


def test_long_texts_and_predictions_against_plain_parsing():
    """Predictions and scores of texts of over 10,000 symbols, and short ones."""
    rng = random.Random(7)
    words = {x: ["".join(rng.choice(y) for _ in range(rng.randrange(2, 8))) for _ in range(60)] for x, y in (("aa", "etaoin"), ("bb", "etrsxy"), ("cc", "lmnoe"))}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    learned = {"aa": say("aa", 600), "bb": say("bb", 600), "cc": say("cc", 3)}
    texts = [say("aa", 3000), say("bb", 2500) + say("aa", 100), say("cc", 2500), say("aa", 4), "x" * 5000, say("bb", 700) * 4]
    got, scores = L.Languages({k: [v] for k, v in learned.items()}, dict.fromkeys(learned, 1 << 20)).predict(pa.array(texts))
    for t, name, score in zip(texts, got, scores):
        costs = {k: longest_matches(t, v) / len(t) for k, v in learned.items()}
        first, second = sorted(costs, key=lambda k: (costs[k], k))[:2]
        assert name == first and score == pytest.approx(costs[second] / (costs[first] + costs[second]))


def test_tiny_languages_do_not_win(spark):
    english = [(i, f"the quick brown fox number {chr(97 + i % 26)} jumps over the lazy dog and sees what was there {'again ' * (i % 3)}", "en") for i in range(60)]
    for junk in ("a", "ok", "hola amigo"):
        df = spark.createDataFrame([*english, (100, junk, "zz"), (104, junk, "zz")], "doc_id long, text string, lang string")
        got = {r["doc_id"]: r["lang_pred"] for r in L.identify(df, L.learn(df)).collect()}
        assert {got[i] for i in range(60)} == {"en"} and {got[100], got[104]} <= {"en", "zz"}
        many = [r["lang_pred"] for r in L.identify(spark.createDataFrame([(1, english[3][1] * 200)], "doc_id long, text string"), L.learn(df)).collect()]
        assert many == ["en"]


def test_more_languages_than_a_fixed_number(spark):
    rng = random.Random(3)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(30)] for k in range(90)}
    rows = [(n, " ".join(rng.choice(w) for _ in range(40)), k) for n, (k, w) in enumerate((k, w) for k, w in words.items() for _ in range(8))]
    df = spark.createDataFrame([(f"d{i}", t, k, 0) for i, t, k in rows], "doc_id string, text string, lang string, Score int").repartition(3)
    model = L.learn(df)
    assert model.names == sorted(words) and sum(len(a.table) // a.width for a in model.automata) <= 2 * L.TOTAL + 90
    out = L.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.98 * len(got)


def test_languages_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = L.query(spark, folder).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    m = got.merge(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (m.lang == m.lang_pred)[m.held_out].mean() > 0.98 and m.score.between(0, 1).all()


def test_languages_odd_rows(spark):
    rows = [(i, "the cat and the dog went over the hill", "en") for i in range(8)] + [(i, "der hund und die katze sind nicht hier", "de") for i in range(8, 16)]
    rows += [(50, None, "en"), (51, "12 34 !!", "de"), (52, "", None), (53, "the dog and the cat " * 5000, None), (54, "日本", "en"), (54, "日本", "en")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, names string").repartition(2)
    got = {r["doc_id"]: r for r in L.identify(df, L.learn(df)).collect()}
    assert [got[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3 and got[53]["lang_pred"] == "en" and got[54]["lang_pred"] != "und"
    nothing = L.learn(df.limit(0))
    assert {r["lang_pred"] for r in L.identify(df, nothing).collect()} == {"und"}


def test_hosts_and_rules(spark):
    rows = {
        1: ("HTTP://WWW.Example.com/en/5?x", "www.example.com", "/en/5", "www.example.com/en/", "allow"),
        2: ("x://m.example.com/en/5", "m.example.com", "/en/5", "example.com/en/", "block"),
        3: ("https://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        4: ("https://a.net/EN/1", "a.net", "/EN/1", None, "allow"),
        5: ("http://b.com", "b.com", "", None, "allow"),
        6: ("http://b.com/", "b.com", "/", "com/", "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme", "", "", None, "allow"),
        9: ("a://b.org?u=c://d/e", "b.org", "", None, "allow"),
        10: ("http://xcom/a", "xcom", "/a", None, "allow"),
        11: ("http://ÉA.net/fr/#t", "Éa.net", "/fr/", "net/fr/", "block"),
    }
    pages = spark.createDataFrame([(k, v[0], "h") for k, v in rows.items()], "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, path string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages, none).collect()}
    assert got == {k: v[1:] for k, v in rows.items()}
    assert U.judge(pages.limit(0), none).count() == 0


def test_templates_and_purity(spark):
    urls = [(i, f"http://spam.org/win/{i}.html") for i in range(60)] + [(100 + i, f"http://fine.org/blog/post-{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)] + [(300 + i, f"http://fine.org/x{'ab'[i % 2]}/{i}") for i in range(40)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    marks = pages.select(U.host_of(pages.url).alias("host"), U.path_of(pages.url).alias("path"), (pages.page_id < 60).cast("int").alias("bad"))
    got = {r["page_id"]: r for r in U.judge(pages, marks).collect()}
    assert len(got) == len(urls)
    assert {r["verdict"] for k, r in got.items() if k < 60} == {"block"} and {r["verdict"] for k, r in got.items() if k >= 60} == {"allow"}
    assert len({r["template"] for k, r in got.items() if k < 60}) == 1
    assert len({r["template"] for k, r in got.items() if 100 <= k < 200}) == 1


def _judged(spark, urls):
    """Pages by number from (url, bad or none)."""
    pages = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(urls)], "page_id long, url string, bad int")
    marks = pages.where("bad is not null").select(U.host_of(pages.url).alias("host"), U.path_of(pages.url).alias("path"), "bad")
    return {r["page_id"]: r for r in U.judge(pages, marks).collect()}


def test_deep_paths_and_frequent_children(spark):
    deep = [(f"http://a.org/a/b/c/d/e/f/g/{'good' if i % 2 else 'bad'}/{i}", 1 - i % 2) for i in range(80)]
    wide = [(f"http://b.org/{w}/{i}", int(w == "casino")) for w in ("casino", "news") for i in range(30)]
    slugs = [(f"http://b.org/{chr(97 + i % 26)}{chr(97 + i // 26)}", None) for i in range(100)]
    got = _judged(spark, deep + wide + slugs)
    assert [got[i]["verdict"] for i in range(80)] == ["allow" if i % 2 else "block" for i in range(80)]
    assert [got[80 + i]["verdict"] for i in range(60)] == ["block"] * 30 + ["allow"] * 30
    assert len({got[140 + i]["template"] for i in range(100)}) == 1


def test_siblings_merge_at_inner_levels(spark):
    """Sparse branches are judged by siblings whose leaves are alike; unlike ones stay apart."""
    urls = [(f"http://a.org/{x}/{y}/{i}", b) for x, k, b in (("aa", 20, 1), ("bb", 2, 1), ("cc", 0, None)) for y in ("p", "q") for i in range(k or 3)]
    other = [(f"http://a.org/zz1/{i}", 0) for i in range(400)]
    got = _judged(spark, urls + other)
    first = [got[i] for i in range(len(urls))]
    assert {r["verdict"] for r in first} == {"block"} and len({r["template"] for r in first}) == 1
    assert {got[len(urls) + i]["verdict"] for i in range(400)} == {"allow"}
    apart = _judged(spark, [(f"http://b.org/{x}/{i}", b) for x, b in (("casino", 1), ("news", 0)) for i in range(30)])
    assert len({r["template"] for r in apart.values()}) == 2


def brute_templates(paths):
    """{(host, path): template} from {(host, path): (pages, labels)}, node by node."""
    def cut_one(s):
        if not re.search("[0-9]", s):
            return s
        m = re.search(r"[^0-9/](\.[A-Za-z]{1,5})$|[0-9](\.[A-Za-z]{1,5})$", s)
        return "*" + ((m.group(2) or "") if m else "")

    rows, done = {k: ("", [cut_one(s) for s in k[1].removeprefix("/").split("/")]) for k in paths}, {}
    while rows:
        nodes, rest = defaultdict(list), {}
        for (h, p), (t, s) in rows.items():
            nodes[h, t].append((p, s))
        for (h, t), found in nodes.items():
            kids = defaultdict(lambda: [0, 0])
            for p, s in found:
                kids[s[0]][0] += paths[h, p][0]
                kids[s[0]][1] += paths[h, p][1]
            few = {c for c, n in kids.items() if c[:1] != "*" and max(n) < U.ENOUGH}
            for p, s in found:
                if len(found) <= U.FANOUT:
                    done[h, p] = t + "/" + "/".join(s)
                    continue
                below = t + "/" + ("*" if s[0] in few and len(few) > U.FANOUT else s[0])
                if s[1:]:
                    rest[h, p] = below, s[1:]
                else:
                    done[h, p] = below
        rows = rest
    return done


def brute_purity(counts):
    """{(host, template): (branch, purity)} from {(host, template): (labels, bad)}."""
    rows = [[h, t, n, b, t[1:].split("/"), t[1:].split("/")] for (h, t), (n, b) in counts.items()]
    parents = defaultdict(set)
    for h, _, _, _, s, _ in rows:
        for at, x in enumerate(s):
            parents[at, h, tuple(s[:at])].add(x)
    for at in sorted({k[0] for k, v in parents.items() if len(v) > 1}, reverse=True):
        each, every = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        key = lambda r: (r[0], tuple(r[4][:at]), tuple(r[5][at + 1 :]))
        shape = lambda x: re.sub("[A-Za-z]+", "a", x)
        for r in rows:
            if len(r[4]) > at:
                for table, last in ((each, r[4][at]), (every, shape(r[4][at]))):
                    table[*key(r), last][0] += r[2]
                    table[*key(r), last][1] += r[3]
        near = defaultdict(set)
        for (*k, x), (n, b) in each.items():
            en, eb = every[*k, shape(x)]
            share = eb / max(en, 1)
            if n == 0 or abs(b / max(n, 1) - share) <= U.Z * math.sqrt(share * (1 - share) / max(n, 1)):
                near[*k, shape(x)].add(x)
        for r in rows:
            if len(r[4]) > at:
                group = near[*key(r), shape(r[4][at])]
                r[5] = [*r[4][:at], U.MERGED + shape(r[4][at]) if r[4][at] in group and len(group) > 1 else r[4][at], *r[5][at + 1 :]]
    pools, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, _, n, b, _, g in rows:
        for table, k in ((pools, (h, "/" + "/".join(g))), (hosts, h)):
            table[k][0] += n
            table[k][1] += b
    overall = sum(r[3] for r in rows) / max(1, sum(r[2] for r in rows))
    out = {}
    for h, t, _, _, _, g in rows:
        branch = "/" + "/".join(g)
        host = (hosts[h][1] + U.ALL_WEIGHT * overall) / (hosts[h][0] + U.ALL_WEIGHT)
        out[h, t] = branch, (pools[h, branch][1] + U.HOST_WEIGHT * host) / (pools[h, branch][0] + U.HOST_WEIGHT)
    return out


def by_brute_force(urls):
    """(template, purity, verdict) of each (url, bad or none)."""
    cut = lambda u: re.match(r"[^:]*(?::(?!//)[^:]*)*://([^/?#]*)([^?#]*)", u or "")
    ends = [(m.group(1).lower(), m.group(2)) if (m := cut(u)) else ("", "") for u, _ in urls]
    paths = defaultdict(lambda: [0, 0, 0])
    for e, (_, b) in zip(ends, urls):
        paths[e][0] += 1
        paths[e][1] += b is not None
        paths[e][2] += b or 0
    found = brute_templates(paths)
    counts = defaultdict(lambda: [0, 0])
    for e, (_, n, b) in paths.items():
        counts[e[0], found[e]][0] += n
        counts[e[0], found[e]][1] += b
    judged = brute_purity(counts)
    for e in ends:
        branch, purity = judged[e[0], found[e]]
        rules = sorted(((len(h + p), v) for h, p, v in U.RULES if (e[0] == h or e[0].endswith("." + h)) and e[1].startswith(p)), reverse=True)
        yield branch, purity, rules[0][1] if rules else "block" if purity >= U.LIMIT else "allow"


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_by_brute_force(spark, seed):
    """A hot host, wide and sparse folders, ties, repeated and odd URLs: templates, purity and verdicts node by node."""
    rng = random.Random(seed)
    words = [a + b for a in ("win", "blog", "x", "shop", "q") for b in ("", "s", "-a", "zz", "_1")]
    urls = []
    for _ in range(700):
        host = rng.choice(["hot.org"] * 5 + ["b.org", "c.net", "www.example.com"])
        path = "".join("/" + rng.choice([rng.choice(words), str(rng.randrange(999)), f"p{rng.randrange(50)}.html", "".join(rng.choice("abcdefgh") for _ in range(4))]) for _ in range(rng.randrange(0, 5)))
        bad = None if rng.random() < 0.4 else int(rng.random() < (0.9 if "win" in path else 0.1))
        urls.append((f"http://{host}{path}{rng.choice(['', '/', '?q=1'])}", bad))
    urls += [(None, None), ("no scheme", None), ("http://hot.org//a//", 1), ("http://hot.org/" + "d/" * 30 + "1", 0), ("http://b.org/" + "long" * 5000, None)] + urls[:40]
    got = _judged(spark, urls)
    for i, (template, purity, verdict) in enumerate(by_brute_force(urls)):
        assert (got[i]["template"], got[i]["verdict"]) == (template, verdict) and got[i]["purity"] == pytest.approx(purity, abs=1e-9), urls[i]
