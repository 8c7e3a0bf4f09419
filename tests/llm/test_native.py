import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import cases
import duckdb

from gaugeworks.llm import quality_rules, queries, url_filter

BLANK = r"[\x20\x09-\x0D]+"


def test_base_measures(spark):
    df = cases.docs(spark, [*cases.texts(), "a b c a b c x", "l1\n\nl1\nl2\nl1 ", "# $ <b> | && * %", "w " * 200])
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        t = r["text"] or ""
        w = [x for x in re.split(BLANK, t) if x]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want[(r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed)] += 1
    told = quality_rules.quality_rules(df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in told) == want
    assert not any(r["kept"] and r["base_failed"] for r in told) and quality_rules.quality_rules(cases.empty(spark)).count() == 0


def test_threshold_table(spark):
    text = "the of and to in " + " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text.replace("word", "$$$$$")), (3, " ".join("x" * 40 + str(i) for i in range(60)))], "doc_id long, text string")
    assert [r["kept"] for r in quality_rules.quality_rules(df).orderBy("doc_id").collect()] == [True, False, False]
    assert all(r["kept"] for r in quality_rules.quality_rules(df, thresholds=()).collect())


def test_stop_words_are_a_ratio(spark):
    """Two stop words are enough for no long text; the share counts, each spelling and each repetition."""
    rest = [f"word{i}" for i in range(94)]
    texts = [" ".join(["the", "of", "The", "AND", "de", "und"] + rest), " ".join(["the", "of", "The", "AND", "de"] + rest + ["x"]), " ".join(["the", "of"] + rest * 20), "the " * 3 + " ".join(rest[:47])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = quality_rules.quality_rules(df).orderBy("doc_id").collect()
    assert [r["stop_word_ratio"] for r in told] == [6 / 100, 5 / 100, 2 / 1882, 3 / 50]
    assert [r["kept"] for r in told] == [True, False, False, True] and not any(r["base_failed"] for r in told if r["doc_id"] != 2)


def test_native_plans(spark):
    for name in ("op7_quality_rules", "op8_url_filter"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, b"x", None) for i, u in enumerate(urls)], "page_id long, url string, html binary, host string")


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for _, rule in url_filter.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7", "https://example.com/en/8?x#y", "http://xexample.com/en/7", "http://example.net/de/8/a", "http://b.example.net/de/9", "http://org/es/", "http://é.org/es", "ftp://com/en/", "http://h?q/en/", "http://h#f", "a://b://c/en/"]
    verdict = dict((r, v) for v, r in url_filter.RULES)
    told = url_filter.url_filter(pages(spark, urls)).collect()
    assert len(told) == len(urls)
    for r in told:
        host, path, rule = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] == verdict.get(rule, "allow")
    assert url_filter.url_filter(pages(spark, [])).count() == 0


def test_templates(spark):
    """A template that rules mostly block is rejected for its unlabelled pages; one that they don't reach isn't."""
    rules = (("block", "h/bad/1"), ("allow", "h/good/1"), ("block", "h/mixed/11"), ("allow", "h/mixed/12"))
    urls = [f"http://h/bad/1{i}" for i in range(20)] + ["http://h/bad/9"]
    urls += [f"http://h/good/1{i}" for i in range(20)] + ["http://h/good/9"]
    urls += [f"http://h/mixed/1{k}{i}" for k in (1, 2) for i in range(10)] + ["http://h/mixed/9"] + ["http://h/other/9", "http://other/bad/9"]
    told = {urls[r["page_id"]]: r["verdict"] for r in url_filter.url_filter(pages(spark, urls), rules).collect()}
    assert [told[f"http://{u}"] for u in ("h/bad/9", "h/good/9", "h/mixed/9", "h/other/9", "other/bad/9")] == ["block", "allow", "allow", "allow", "allow"]


def slow_tree(urls, rules, max_children=20, rare=0.02, min_support=5, purity=0.8, prior_weight=4.0, z=1.96):
    """Verdicts by the definition, page by page."""

    def judged(url):
        host, path, _ = brute_url(url)
        fits = [(len(t), v) for v, t in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        shape = tuple("*" if re.search(url_filter.VARIABLE.replace(r"\z", r"\Z"), x) else x for x in path.split("/") if x)
        return host, path, shape, max(fits)[1] if fits else None

    every = [judged(u) for u in urls]
    rows = sorted({(h, p): (h, s, g) for h, p, s, g in every}.values(), key=str)  # each path once
    children = Counter((h, s[:k], s[k]) for h, s, _ in rows for k in range(len(s)))
    kinds, whole = Counter((h, p) for h, p, _ in children), Counter()
    for (h, p, _), n in children.items():
        whole[h, p] += n
    wild = lambda h, s, k: kinds[h, s[:k]] > max_children and children[h, s[:k], s[k]] < rare * whole[h, s[:k]]
    template = lambda h, s: tuple("*" if wild(h, s, k) else x for k, x in enumerate(s))
    bad, labelled, size = Counter(), Counter(), Counter()
    for h, s, given in rows:
        t = template(h, s)
        for k in range(len(t) + 1):
            size[h, t[:k]] += 1
            bad[h, t[:k]] += given == "block"
            labelled[h, t[:k]] += given is not None
    known = [(h, t) for h, t in labelled if t and labelled[h, t] >= min_support]
    merged = {}
    for h, parent in {(h, t[:-1]) for h, t in known}:
        own = [t for g, t in known if g == h and t[:-1] == parent]
        total = sum(labelled[h, t] for t in own)
        share = sum(bad[h, t] for t in own) / total
        alike = [t for t in own if abs(bad[h, t] / labelled[h, t] - share) <= z * (share * (1 - share) * (1 / labelled[h, t] + 1 / total)) ** 0.5]
        merged |= {(h, t): tuple(sum(c[h, x] for x in alike) for c in (bad, labelled, size)) for t in alike}
    out = []
    for h, _, s, given in every:
        t, p = template(h, s), 0.5
        for k in range(len(t) + 1):
            b, n, whole_ = merged.get((h, t[:k]), (bad[h, t[:k]], labelled[h, t[:k]], size[h, t[:k]]))
            if n:
                p += n / whole_ * (n / (n + prior_weight)) * (b / n - p)
        out.append(given or ("block" if p >= purity else "allow"))
    return out


def test_tree_against_brute_force(spark):
    import random

    r = random.Random(4)
    rules = (("block", "h1/a/x"), ("allow", "h1/a/x/ok"), ("block", "h2/"), ("allow", "h2/fine/"), ("block", "net/de/"), ("allow", "h3.net/de/2"))
    names = ["a", "b", "fine", "de", "x", "ok", "news", "u"]
    urls = [None, "http://h1", "http://h1/"]
    for _ in range(1500):
        host = r.choice(["h1", "h2", "www.h1", "h3.net", "h4.net", "H2", "other"])
        depth = r.choice([0, 1, 2, 3, 3, 4, 6])
        parts = [r.choice(names) if r.random() < 0.75 else r.choice([str(r.randint(1, 400)), f"page-{r.randint(100, 999)}", f"slug{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}"]) for _ in range(depth)]
        urls.append(f"http://{host}/" + "/".join(parts) + r.choice(["", "/", "?q=1"]))
    told = {x["page_id"]: x["verdict"] for x in url_filter.url_filter(pages(spark, urls), rules).collect()}
    want = slow_tree(urls, rules)
    assert [told[i] for i in range(len(urls))] == want and {"allow", "block"} == set(want)


def test_the_tree_reaches_the_whole_depth(spark):
    """Branches that part at the fourth segment, and pages that only their ancestors' labels reach."""
    rules = (("block", "h/a/b/c/spam/"), ("allow", "h/a/b/c/news/"))
    urls = [f"http://h/a/b/c/{x}/{i}" for x in ("spam", "news") for i in range(100, 130)]
    more = ["http://h/a/b/c/spam", "http://h/a/b/c/news", "http://h/a/b/c/other", "http://g/a/b/c/spam"]
    told = {(urls + more)[r["page_id"]]: r["verdict"] for r in url_filter.url_filter(pages(spark, urls + more), rules).collect()}
    assert [told[u] for u in more] == ["block", "allow", "allow", "allow"]
    only = [f"http://s/en/{i}" for i in range(100, 130)] + ["http://s/de/1", "http://s", "http://s/x/y/z"]
    told = {only[r["page_id"]]: r["verdict"] for r in url_filter.url_filter(pages(spark, only), (("block", "s/en/"),)).collect()}
    assert set(told.values()) == {"block"}


def _site(name, pages_, labelled):
    """A site with a branch that a rule blocks and one that no rule reaches, of the given numbers of pages."""
    return [f"http://{name}/es/{1000 + i}" for i in range(labelled)] + [f"http://{name}/en/{5000 + i}" for i in range(pages_ - labelled)]


def test_verdicts_do_not_depend_on_the_number_of_pages(spark):
    """The same pages ten times, and sites ten times as large: a branch isn't blocked for what a rule says of its sibling."""
    sites = {"small.org": (130, 12), "even.org": (40, 20), "mostly.org": (50, 48)}
    urls = [u for n, (p, b) in sites.items() for u in _site(n, p, b)] + [f"http://com/en/{i}" for i in range(100, 140)] + ["http://com/fr/1"]
    grown = [u for n, (p, b) in sites.items() for u in _site(n, 10 * p, 10 * b)] + [f"http://com/en/{i}" for i in range(1000, 1400)] + ["http://com/fr/1"]
    rules = url_filter.RULES
    verdict = lambda us: {(brute_url(us[r["page_id"]])[:2], r["verdict"]) for r in url_filter.url_filter(pages(spark, us), rules).collect()}
    once, often = verdict(urls), verdict(urls * 10)
    assert once == often
    by = lambda told: {(h, p.split("/")[1]): v for (h, p), v in told}
    assert by(once) == by(verdict(grown)) == {("small.org", "es"): "block", ("small.org", "en"): "allow", ("even.org", "es"): "block", ("even.org", "en"): "allow",
                                              ("mostly.org", "es"): "block", ("mostly.org", "en"): "block", ("com", "en"): "block", ("com", "fr"): "block"}


def test_sql_where_the_tree_says_both(spark):
    """The oracle on pages that rules reach in part: the tree blocks some of the others and allows some."""
    urls = _site("a.org", 130, 12) + _site("b.org", 50, 48) + [f"http://example.com/en/{i}" for i in (*range(100, 130), *range(700, 705))] + ["http://example.com/en", "http://example.com/x/y", "http://d.net/de", None] * 2
    urls += [f"http://net/{k}/{n}" for k in ("de", "fr") for n in range(100, 130)] + [f"http://b.org/en/{chr(97 + i)}{chr(97 + j)}q" for i in range(6) for j in range(6)]
    duck = duckdb.connect()
    table = pages(spark, urls)
    frame = table.select("page_id", "url").toPandas()
    duck.register("pages", frame)
    want = {(r[0], r[-1]) for r in duck.sql(url_filter.SQL).fetchall()}
    told = url_filter.url_filter(table).collect()
    assert {(r["page_id"], r["verdict"]) for r in told} == want
    assert {r["verdict"] for r in told if r["rule"] is None} == {"allow", "block"}


def test_sample_pages_ten_times(spark):
    once = url_filter.op8_url_filter(spark, "/root/testdata/sf0.01")
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    often = url_filter.url_filter(rows.crossJoin(spark.range(10)).drop("id"))
    key = lambda df: {(r["page_id"], r["verdict"]) for r in df.collect()}
    assert key(once) == key(often)


def test_many_children_become_a_wildcard(spark):
    rules = (("block", "h/u/a"),)
    urls = [f"http://h/u/a{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)] + ["http://h/u/zz"]
    told = {urls[r["page_id"]]: r["verdict"] for r in url_filter.url_filter(pages(spark, urls), rules).collect()}
    assert told["http://h/u/zz"] == "block"


def test_oracles(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        a, b = queries.QUERIES[name](spark, d).toPandas(), c.sql(sql).df()
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        key = lambda x: sorted(tuple(map(str, r)) for r in x[columns].itertuples(index=False))
        assert key(a) == key(b), name
