"""HTML extraction, URL filter and nearest neighbours."""

import html
import re

import numpy as np
import pytest

from tabulare.llm import ann, html_extract, url_filter

from .conftest import SF


# ---------------------------------------------------------------- 2 HTML
def _article(page):
    """The article of the driver's pages, whose markup is known."""
    a = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?p>|</?h1>", a)]
    return "\n".join(b for b in blocks if b)


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == _article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_boilerplate_of_many_kinds():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1><p>Tagline of the site goes here.</p></header>
    <div id="menu"><ul><li><a href=1>Home</a><li><a>News</a></ul></div><div class="cookie-notice"><p>We use cookies to improve your experience,
    please accept them all for advertising.</p></div><div class=content><h2>Real title</h2><p>First paragraph of the story, with &amp; and &eacute;.
    <p>Second   one, <a href=x>a link</a> and <b>bold</b>text. Short.</p><script>var a="<p>no</p>";</script><p>Ok.</p>
    <div class="share-buttons">Share this on all of your networks now please</div><p>Third paragraph, again with enough words.</p></div>
    <aside><p>Sidebar text, long enough to be confused with an article of many words.</p></aside><section id="comments"><article><p>I think
    that this is a wonderful article, thanks a lot for it!</p></article></section><form><p>Leave a reply in this form.</p></form><footer>&copy; Foo</footer>"""
    assert html_extract.main_text(page).split("\n") == [
        "Real title", "First paragraph of the story, with & and é.", "Second one, a link and boldtext. Short.", "Ok.",
        "Third paragraph, again with enough words."]


S = "The old bridge over the river was closed again this week while engineers looked for new cracks in it."
OTHER = "A second paragraph tells how long the town has been waiting for the repair, and what it may cost them."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = '<footer><p>&copy; 2024 The Town Paper. All rights reserved.</p></footer>'


@pytest.mark.parametrize("body, want", [
    (f'<article><p>{OTHER}</p><p data-title="Hidden treasures">{S}</p></article>', [OTHER, S]),
    (f'<article><p>{S} <a href="/hidden-valley?id=comment-5&class=menu">there</a></p></article>', [S + " there"]),
    (f'<div class="page with-sidebar"><article><p>{S}</p></article></div>', [S]),
    (f'<div class="sidebar-left page"><article><p>{S}</p><p>{OTHER}</p></article></div>', [S, OTHER]),
    (f'<div class="legal social widget"><article><p>{S}</p></article></div><section id="comments"><article><p>{OTHER}</p></article></section>', [S]),
    (f'<form id="aspnet"><main><p>{S}</p></main></form>', [S]),
    (f'<form id="aspnet">{NAV}<div><p>{S}</p><p>{OTHER}</p><p>{S}</p><p>{OTHER}</p></div></form>', [S, OTHER, S, OTHER]),
    (f'<article><p>{OTHER}</p><p><a href="/x">{S}</a></p></article>', [OTHER, S]),
    (f'<div class="content"><p>{OTHER}</p><p class="legal">{S}</p><p>{OTHER}</p></div>', [OTHER, S, OTHER]),
    (f'<div class="content"><h1>Closed again</h1><p>{S}</p><p>{OTHER}</p></div>', ["Closed again", S, OTHER]),
    (f'<article><header><h1>Closed again</h1></header><p>{S}</p><div class="share-box">Share this with friends</div><p>{OTHER}</p>'
     '<div class="related"><ul><li><a href="/1">Another story of the town</a></li></ul></div></article>', ["Closed again", S, OTHER]),
    (f'<div class="story"><p>{S}</p><p>{OTHER}</p></div><aside><article><p>{S}</p></article><article><p>{OTHER}</p></article></aside>', [S, OTHER]),
    (f'<div><p>{S}</p><p>{OTHER}</p></div><div class="sidebar"><p>{OTHER}</p><p>{S}</p></div>', [S, OTHER]),
    (f'<div hidden><p>{OTHER}</p></div><p>{S} <span style="display: none">never shown</span></p>', [S]),
    ("<div>" * 80 + f"<ul><li>{S}<li>" + "<span><b><i><u><em>" + OTHER + "</div>" * 80, [S, OTHER]),
], ids=range(15))
def test_names_are_a_cost_and_no_veto(body, want):
    page = f"<html><head><title>t</title></head><body>{NAV}{body}{FOOT}</body></html>"
    assert html_extract.main_text(page).split("\n") == want


def test_pages_without_article_markup(spark):
    """The driver's pages with their articles in plain divisions."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = [html_extract.main_text(re.sub(r"<(/?)article\b", r"<\1div", r.html)) == _article(r.html) for r in pages]
    assert sum(found) >= 0.9 * len(found)


def test_cut_is_the_cheapest_labelling():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        s, t = rng.random(n) * 3, rng.random(n) * 3
        edges = [(int(a), int(b), float(rng.random())) for a, b in rng.integers(0, n, (int(rng.integers(0, 12)), 2)) if a != b]
        cost = lambda x: sum(t[i] if x >> i & 1 else s[i] for i in range(n)) + sum(c for a, b, c in edges if (x >> a ^ x >> b) & 1)
        cut = html_extract.minimum_cut(list(s), list(t), edges)
        assert abs(cost(sum(1 << i for i in range(n) if cut[i])) - min(map(cost, range(1 << n)))) < 1e-6


def test_html_odd_input(spark):
    data = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<article><p>One two three.</p></article>"), (4, "u", "<article><p>One two three.</p></article>"),
            (5, "u", "<div>" * 3000 + "<article>" + "<p>word word word.</p>" * 3000), (6, "u", "<article><p>cut <!-- off"), (7, "u", "<article><p>a<b class='x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()]
    assert got[:3] == [(1, "", 0), (2, "", 0), (None, "", 0)] and got[3] == got[4] == (4, "One two three.", 14)
    assert got[5][1].count("\n") == 2999 and got[6][1] == "cut" and got[7][1] == "a"
    assert html_extract.extract(df.where("false")).count() == 0


# ---------------------------------------------------------------- 6 URLs
def test_url_rules(spark):
    urls = ["http://A.Net/x", "https://sub.example.net/en/1?q", "https://example.net/enx", "http://example.com/de/#f", "http://www.example.com/de",
            "ftp://x.org/fr/a", "http://org", "http://notnet/", None, "no scheme", "http://?x", "://h.net/", "http://x.net?a/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, none).collect()}
    assert got == {0: ("a.net", "/x", "net/", "block"), 1: ("sub.example.net", "/en/1", "example.net/en/", "allow"),
                   2: ("example.net", "/enx", "net/", "block"), 3: ("example.com", "/de/", "example.com/de/", "block"),
                   4: ("www.example.com", "/de", None, "allow"), 5: ("x.org", "/fr/a", "org/fr/", "allow"), 6: ("org", "", None, "allow"),
                   7: ("notnet", "/", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
                   11: ("h.net", "/", "net/", "block"), 12: ("x.net", "", None, "allow")}
    assert url_filter.judge(df.where("false"), none).count() == 0


def test_bad_hosts_are_blocked_by_posterior_bound(spark):
    rows, out = [], []
    for host, n, bad in (("a.bad.com", 60, 60), ("b.bad.com", 30, 30), ("new.bad.com", 3, 0), ("x.good.com", 400, 4), ("one.other.com", 1, 1)):
        for i in range(n):
            rows.append((len(rows), f"http://{host}/p{i}"))
            if host != "new.bad.com":
                out.append((len(rows) - 1, int(i < bad)))
    df, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(out + [(None, 1), (10 ** 6, 1)], "page_id long, bad int")
    verdict = {r.host: r.verdict for r in url_filter.judge(df, labels, rules=(("none.example", "/", "block"),)).collect()}
    assert verdict["a.bad.com"] == verdict["b.bad.com"] == "block"
    assert verdict["x.good.com"] == "allow" and verdict["one.other.com"] == "allow"        # one bad page is no reputation
    hosts = spark.createDataFrame([("a.bad.com", 60, 60), ("new.bad.com", 0, 0), ("x.good.com", 400, 4), ("new.good.com", 0, 0)], "host string, n long, bad long")
    mean = {r.host: r.mean for r in url_filter.host_reputation(hosts).collect()}
    assert mean["new.bad.com"] > 0.6 > 0.3 > mean["new.good.com"]                           # inherited from the domain


def test_registered_domains(spark):
    df = spark.createDataFrame([("a.b.example.co.uk",), ("x.example.com",), ("com",), ("",), ("1.2.3.4",), ("co.uk",)], "host string")
    d, s = url_filter.domain_parts(df["host"])
    assert [tuple(r) for r in df.select(d, s).collect()] == [
        ("example.co.uk", "co.uk"), ("example.com", "com"), ("com", "com"), ("", ""), ("1.2.3.4", "1.2.3.4"), ("co.uk", "uk")]


# ---------------------------------------------------------------- 10 nearest neighbours
def _exact(ids, x, q, k=10):
    d = np.sqrt(((x - q[1]) ** 2).sum(1))
    return sorted((float(v), int(i)) for v, i in zip(d, ids) if i != q[0])[:k]


def test_neighbours_against_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(e.collect(), key=lambda r: r.vec_id)
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    hit = total = 0
    got = {}
    for r in ann.search_every(e).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert sorted(got) == [i for i in ids if i % 100 == 0]
    for q, found in got.items():
        want = _exact(ids, x, (q, x[np.searchsorted(ids, q)]))
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        near = dict((i, d) for d, i in _exact(ids, x, (q, x[np.searchsorted(ids, q)]), len(ids)))
        assert all(abs(near[i] - s) < 1e-12 for _, s, i in found)
        hit += len({f[2] for f in found} & {i for _, i in want})
        total += 10
    assert hit / total >= 0.9


def test_graph_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(600, 16))
    graph = ann.CentroidGraph.build(c)
    x = rng.normal(size=(50, 16))
    ids, dist = graph.search(x, 10)
    true = np.argsort(((x[:, None] - c) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.95 and (np.diff(dist, axis=1) >= 0).all()


def test_probes_visit_the_centroids_near_the_query_only():
    """Clustered vectors: the lists to read are found without going through a tenth of the centroids."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 32)) * 4
    c = (centres[:, None, :] + 0.5 * rng.normal(size=(60, 50, 32))).reshape(-1, 32)
    x = centres[rng.integers(60, size=80)] + 0.5 * rng.normal(size=(80, 32))

    class Counted:
        def __init__(self, a):
            self.a, self.n = a, 0

        def __getitem__(self, i):
            self.n += np.asarray(i).size
            return self.a[i]

        def __len__(self):
            return len(self.a)

    graph = ann.CentroidGraph.build(c)
    graph.centroids = Counted(c)
    probes = graph.probes_of(x)
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    found = []
    for i, lists in enumerate(probes):
        order = np.argsort(d[i])
        want = set(order[:ann.PROBES].tolist()) | set(np.flatnonzero(d[i] <= ann.PRUNE * d[i].min()).tolist())
        found.append(len(want & set(lists.tolist())) / len(want))
    assert np.mean(found) > 0.95 and graph.centroids.n / len(x) < 0.1 * len(c)


def test_lists_are_balanced():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(900, 8)) * 0.01, rng.normal(size=(124, 8)) + 5])
    c = ann.balanced_centroids(x, 8)
    size = np.bincount(np.argmin(((x[:, None] - c) ** 2).sum(2), axis=1), minlength=8)
    assert len(c) == 8 and size.max() < 3 * len(x) / 8


@pytest.mark.parametrize("shard", [1024, 3])
def test_neighbours_odd_input(spark, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", shard)
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []),
            (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (200, [0.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    data += [(1000 + i, [1.0, 0.0]) for i in range(1, 30)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS list", "3 AS score")
    got = {}
    for r in ann.search_every(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [0, 100]                           # unusable vectors ask nothing
    assert [v for _, v, _ in sorted(got[0])] == [1, 2, 100, 1001, 1002, 1003, 1004, 1005, 1006, 1007]     # ties: smaller ids
    assert [v for _, v, _ in sorted(got[100])][:3] == [0, 1, 2]
    few = ann.search_every(df.where("vec_id IN (0, 1, 3)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few)] == [(0, 1, 1), (0, 2, 3)]
    assert ann.search_every(df.where("false")).count() == 0
