"""Decontamination, HTML, URLs and chat formatting on small fixtures."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polarmesh.llm import chat, decontaminate, html_extract, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=13):
    windows = {}
    for i, t in items:
        w = tokens(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i) if i is not None else "null")
    out = Counter()
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (10, "cat sat"), (2, "a a a a a a a a a a a a a a a"), (3, None), (None, "zed"), (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (4, "  ")]


def some_docs():
    base = ITEMS[0][1]
    return [(1, "x " + base + " y " + base.upper()), (2, " ".join(base.split()[1:])), (3, "The CAT-sat."), (4, "a " * 14), (5, "a " * 12), (6, None), (7, ""), (None, "zed zed"), (7, ""), (8, "filler " * 400 + base), (9, " ".join(base.split()[::-1]))]


@pytest.mark.parametrize("salt_rows", [50_000, 1])
def test_phrases_match_brute_force(spark, odd_docs, salt_rows):
    docs = spark.createDataFrame(some_docs(), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter(map(tuple, decontaminate.contamination(decontaminate.match_items(docs, items, 13, salt_rows=salt_rows)).collect()))
    assert got == brute(some_docs(), ITEMS)
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = Counter(map(tuple, decontaminate.contamination(decontaminate.match_items(odd_docs, items, 13, salt_rows=salt_rows)).collect()))
    assert got == brute(odd, ITEMS)


def test_phrases_on_the_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    got = Counter(map(tuple, decontaminate.contamination(decontaminate.match_items(docs, items)).collect()))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])


def test_hot_terms_are_dealt_to_salts(spark):
    """Items of the most frequent words only, and a passage that all documents share."""
    shared = "the of and to in the of and to in the of and to in on at"
    rows = [(k, f"own{k} the of and {shared if k % 3 else shared[4:]} and the to {k} of in") for k in range(60)]
    items = [(1, shared), (2, "the of and"), (3, shared + " extra")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for salt_rows in (50_000, 20):
        assert Counter(map(tuple, decontaminate.contamination(decontaminate.match_items(docs, bench, salt_rows=salt_rows)).collect())) == brute(rows, items)


def test_windows_take_their_rarest_terms(spark):
    places = spark.createDataFrame([(7, q, 0, n) for q, n in enumerate([5, 1, 4, 1, 9])] + [(8, 0, 0, 3)], "item long, q int, term long, n long")
    got = {r["item"]: (r["n_words"], [tuple(w) for w in r["windows"]]) for r in decontaminate.windows(places, 3).collect()}
    assert got == {7: (5, [(0, 1, 2), (1, 1, 3), (2, 3, 2)]), 8: (1, [(0, 0, 0)])}


def test_no_items_or_documents(spark, no_docs):
    docs, items = spark.createDataFrame(some_docs(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(decontaminate.match_items(docs, items.limit(0))).collect()} == {0}
    assert decontaminate.contamination(decontaminate.match_items(no_docs, items)).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "delta x beta alpha gamma"), (2, "alpha " + "x " * 30 + "beta gamma delta"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.match_items(docs, items, span=8).collect()}
    assert rows[1]["near"] and not rows[1]["hits"]
    assert not rows[2]["near"]
    assert rows[3]["near"] and rows[3]["hits"]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>site</header><nav><ul><li><a href="/a">a{k}</a></li><li><a href="/b">b</a></li></ul></nav><div class="cookie-notice">ok?</div>
<article><h1>Title {k} &amp; more</h1><p>First <b>bo</b>ld &lt;x&gt;<br>line.<p>Second{k}   one</p><aside>side</aside><form><input>f</form><section id="comments"><p>bad</p></section></article>
<div class="sidebar"><p>s</p></div><footer>&copy; x</footer>"""


def test_wrappers_extract_articles(spark):
    rows = [(k, f"http://h{k % 2}.example.com/{k}", PAGE.format(k=k)) for k in range(7)]
    rows += [(7, None, None), (8, "nonsense", ""), (9, "http://x.y/", "plain <b>te</b>xt &eacute; <"), (None, "http://h1.example.com/", PAGE.format(k=9)), (7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in (64_000_000, 10):  # broadcast and joined
        got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extract.main_text(pages, broadcast_bytes=size).collect())
        text = lambda k: f"Title {k} & more First bold <x> line. Second{k} one"
        want = Counter((i, u, t, len(t)) for i, u, t in [*((k, f"http://h{k % 2}.example.com/{k}", text(k)) for k in range(7)), (7, None, ""), (7, None, ""), (8, "nonsense", ""), (9, "http://x.y/", "plain text é <"), (None, "http://h1.example.com/", text(9))])
        assert got == want
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_wrapper_is_union_free():
    pages = [PAGE.format(k=k) for k in range(3)] + ["<html><head></head><body><nav></nav><article><p>a<p>b<p>c</article></body></html>"]
    w = None
    for p in pages:
        e = html_extract.expression(html_extract.parse(p))
        w = html_extract.align(w, e) if w else e
    text = html_extract.regular_expression(w)
    assert "|" not in text and "(<h1>" in text and ")?" in text and "#TEXT" in text


def test_pages_without_article():
    pages = [f"<body><div class='top'><p>Same words here</p></div><div><p>Story {k} is long and told</p></div><ul><li><a href=x>l{k}</a></li><li><a href=y>m</a></li></ul></body>" for k in range(4)]
    w = None
    for p in pages:
        e = html_extract.expression(html_extract.parse(p))
        w = html_extract.align(w, e) if w else e
    assert [html_extract.extract(p, w) for p in pages] == [f"Story {k} is long and told" for k in range(4)]


def alone(page):
    return html_extract.extract(page, html_extract.expression(html_extract.parse(page)))


@pytest.mark.parametrize("body", ["single has-sidebar", "no-sidebar", "with-comments", "search social"])
@pytest.mark.parametrize("around", ["layout-sidebar-right", "has-sidebar", "two-columns-sidebar", "widget"])
@pytest.mark.parametrize("article", ["post category-social", "tag-legal", "tag-advertising", "social"])
def test_layout_classes_keep_the_article(body, around, article):
    page = f'<html class="with-comments"><body class="{body}"><nav>n</nav><div class="{around}"><div class="left-sidebar">s</div><article class="{article}"><p>The text</p><div class="post-share">t</div><div class="comments"><article class="comment">c</article></div></article></div></body></html>'
    assert alone(page) == "The text"
    # the same layout without a marked article, and with <main>
    assert alone(f'<body class="{body}"><div class="layout-sidebar-right"><p>The text</p><div class="sidebar">s</div></div></body>') == "The text"
    assert alone(f'<body><main class="{article} no-sidebar"><div class="topic-legal">The text</div></main></body>') == "The text"


def test_related_articles_do_not_replace_the_page():
    assert alone('<body><p>A text that is not marked</p><div class="related"><article>Teaser</article></div></body>') == "A text that is not marked"
    assert alone('<body><article class="post">Text</article><article class="comment-body">c</article></body>') == "Text"
    assert alone('<body><div class="my-footer">All there is</div></body>') == "All there is"


def wrapper_of(pages):
    w = None
    for p in pages:
        e = html_extract.expression(html_extract.parse(p))
        w = html_extract.align(w, e) if w else e
    return w


# class names that say nothing: a strap line that varies, constant words, the article, lines about other pages
NAMELESS = '<body><div class="qa">Day {k}</div><div class="qb"><div class="qc">All the same here</div><div class="qd"><h2>Head {k}</h2><p>{body}</p><p>End {k}</p></div><div class="qe"><p>More {k}</p></div></div><div class="qf">Page {k} of many</div></body>'


def test_wrappers_find_articles_without_names():
    pages = [NAMELESS.format(k=k, body=f"Story {k} " * 40) for k in range(5)]
    want = [" ".join(f"Head {k} {f'Story {k} ' * 40} End {k}".split()) for k in range(5)]
    aligned = wrapper_of(pages)
    assert [html_extract.extract(p, aligned) for p in pages] == want
    assert all(alone(p) != t for p, t in zip(pages, want, strict=True))  # one page doesn't tell
    short = NAMELESS.format(k=9, body="Brief")  # the host tells where a short article is
    assert html_extract.extract(short, aligned) == "Head 9 Brief End 9"
    other = "<body><div class='zz'><p>Not made like the others</p></div></body>"
    assert html_extract.extract(other, aligned) == "Not made like the others"
    only_aside = '<body><div class="qa">Day 7</div></body>'
    assert html_extract.extract(only_aside, aligned) == "Day 7"  # nothing else is there


def test_marked_teasers_are_no_articles():
    page = '<body><div class="x"><p>{body}</p></div><div class="y"><article>Read {k} too</article></div></body>'
    pages = [page.format(k=k, body=f"The story {k} goes on. " * 30) for k in range(4)]
    got = [html_extract.extract(p, wrapper_of(pages)) for p in pages]
    assert got == [" ".join((f"The story {k} goes on. " * 30).split()) for k in range(4)]


def test_small_parts_of_articles_stay():
    page = '<body><div class="x"><h1>Head {k}</h1><p>{body}</p><div class="z">Note {k}</div><p>Last {k}</p></div></body>'
    pages = [page.format(k=k, body=f"The story {k} goes on. " * 30) for k in range(4)]
    got = [html_extract.extract(p, wrapper_of(pages)) for p in pages]
    assert got == [" ".join(f"Head {k} {f'The story {k} goes on. ' * 30} Note {k} Last {k}".split()) for k in range(4)]


def test_hot_host_by_both_ways(spark):
    rows = [(k, f"http://{'hot' if k % 3 else f'h{k}'}.example.com/{k}", NAMELESS.format(k=k, body=f"Story {k} " * 40)) for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    ways = [html_extract.main_text(pages), html_extract.main_text(pages, broadcast_bytes=1, pages_dealt=10)]
    got = [{r["page_id"]: r["text"] for r in way.collect()} for way in ways]
    assert got[0] == got[1] and len(got[0]) == 120
    assert all(got[0][k] == " ".join(f"Head {k} {f'Story {k} ' * 40} End {k}".split()) for k in range(120) if k % 3)


def test_wrappers_do_not_depend_on_partitions(spark):
    rows = [(k, "http://h.example.com/", NAMELESS.format(k=k, body=f"Story {k} " * 40) if k % 2 else PAGE.format(k=k)) for k in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [{r["page_id"]: r["text"] for r in html_extract.main_text(pages.repartition(n)).collect()} for n in (1, 4, 11)]
    assert got[0] == got[1] == got[2]


def test_deep_pages(spark):
    for deep in (200, 5000):
        quotes, fonts = "<div>" * deep, "<font>" * deep
        page = f'<body><div><article><p>Begin</p>{quotes}<nav>menu</nav><div class="comments">no</div>deep{"</div>" * deep}<p>End</p></article></div><div>after</div></body>'
        assert alone(page) == "Begin deep End"
        assert alone(f"<body>{fonts}<div><article><p>Begin</p></article></div></body>") == "Begin"
        w = html_extract.expression(html_extract.parse(page))
        w = html_extract.align(w, html_extract.expression(html_extract.parse(page.replace("deep", "other"))))
        back = html_extract.unpack(html_extract.pack(w))
        assert html_extract.regular_expression(back) == html_extract.regular_expression(w)
        assert html_extract.extract(page, back) == "Begin deep End"
    pages = spark.createDataFrame([(k, "http://h.example.com/", page) for k in range(3)], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.main_text(pages).collect()] == ["Begin deep End"] * 3


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_comments_forms_and_adverts_inside_an_article(spark):
    boxes = ["comments-list", "comment-form", "comments-area", "ad-box", "comments", "ads_top"]
    inside = "".join(f'<div {kind}="{name}">gone {name}</div>' for name in boxes for kind in ("class", "id"))
    kept = '<div class="has-comments">one</div><div class="category-ads">two</div><p class="adverb">three</p><div class="commentary">four</div>'
    rows = [(k, f"http://h.example.org/{k}", f"<body><article><p>Page {k} text</p>{inside}{kept}<p><a href=/x/>link</a> and <span/>after</p></article></body>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    assert got == {k: f"Page {k} text one two three four link and after" for k in range(6)}


def test_comments_forms_and_adverts_inside_an_article(spark):
    boxes = ["comments-list", "comment-form", "comments-area", "ad-box", "comments", "ads_top"]
    inside = "".join(f'<div {kind}="{name}">gone {name}</div>' for name in boxes for kind in ("class", "id"))
    kept = '<div class="has-comments">one</div><div class="category-ads">two</div><p class="adverb">three</p><div class="commentary">four</div>'
    rows = [(k, f"http://h.example.org/{k}", f"<body><article><p>Page {k} text</p>{inside}{kept}<p><a href=/x/>link</a> and <span/>after</p></article></body>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    assert got == {k: f"Page {k} text one two three four link and after" for k in range(6)}


def test_urls(spark):
    cases = [
        ("http://WWW.Example.org/es/1?x", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("https://a.example.org/en/12#f", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("https://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
        ("https://example.org", "example.org", "", None, "allow"),
        ("http://cheap-pills.example.com/fr/1", "cheap-pills.example.com", "/fr/1", "com/fr/", "allow"),
        ("http://cheappills.example.net/en/1", "cheappills.example.net", "/en/1", None, "block"),
        ("http://m.freebets.example.net/", "m.freebets.example.net", "/", None, "block"),
        ("http://oceanresearch.example.net/en/1", "oceanresearch.example.net", "/en/1", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("ftp://h?q=://z/", "h", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, RULES).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_words_are_counted_whole(spark):
    word = F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    many = spark.range(21_000).select(F.concat(F.lit("http://h.example.org/"), word, F.lit("/"), word).alias("url"))
    rare = spark.createDataFrame([("http://betsy.example.net/",), ("http://h.example.org/betsy",)], "url string")
    pages = many.unionByName(rare).withColumn("page_id", F.lit(1))
    host, path = url_filter.url_parts(F.col("url"))
    words = url_filter.word_counts(pages.select(host.alias("host"), path.alias("path")))
    assert words.count() == 21_001 and words.agg(F.sum("count")).first()[0] == 42_001 and words.where("word = 'betsy'").first()["count"] == 1
    got = {r["host"]: (r["verdict"], r["tokens"]) for r in url_filter.judge(pages, {}).where("host LIKE 'betsy%'").collect()}
    assert got == {"betsy.example.net": ("allow", ["betsy", "example", "net"])}


def test_copies_of_a_table_split_alike(spark):
    urls = ["http://river-casino.example.net/casino/river", "http://rivercasinoo.example.net/x", "http://in-art.example.net/in/art/ride", "http://inarticle.example.net/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    more = pages.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n")
    rows = lambda df: {(r["page_id"], r["verdict"], round(r["log_odds"], 9), *r["tokens"]) for r in url_filter.judge(df, {}).collect()}
    assert rows(pages) == rows(more) and len(rows(pages)) == 4


def test_viterbi_matches_all_splits():
    import itertools

    model = url_filter.Segmenter({"cheap": 5, "che": 2, "ap": 3, "pills": 4, "pill": 4, "s": 1})
    name = "cheappills"

    def cost(words):
        return sum(model.total + (-math.log(model.counts[w]) if w in model.counts else 4 + 2.5 * len(w)) for w in words)

    best = min((cost([name[a:b] for a, b in zip((0, *cut), (*cut, len(name)), strict=True)]) for n in range(len(name)) for cut in itertools.combinations(range(1, len(name)), n)))
    assert abs(cost(model.split(name)) - best) < 1e-9 and model.split(name) == ["cheap", "pills"]


def bayes_brute(sites, blocked, allowed, rounds):
    """Log odds of each site (a list of tokens) by expectation maximisation, without Spark."""
    tallies = {"seed": [Counter(t for n in names for t in n.split()) for names in (blocked, allowed)]}
    prior, weight = math.log(0.1 / 0.9), {}

    def learn():
        tokens = {t for sides in tallies.values() for side in sides for t in side}

        def share(kind, side, t):
            own, told = tallies[kind][side], url_filter.SITE_PRIOR if kind == "site" else 0
            both = sum(sum(c.values()) for c in tallies[kind])
            return (own[t] + told * sum(c[t] for c in tallies[kind]) / both) / (sum(own.values()) + told) + 0.1 / len(tokens)

        return {t: math.log(sum(share(k, 0, t) for k in tallies)) - math.log(sum(share(k, 1, t) for k in tallies)) for t in tokens}

    odds = lambda: [prior + sum(weight.get(t, 0) for t in site) for site in sites]
    weight = learn()
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-x)) for x in odds()]
        tallies["site"] = [Counter(), Counter()]
        for site, x in zip(sites, p, strict=True):
            for t in site:
                tallies["site"][0][t] += x
                tallies["site"][1][t] += 1 - x
        weight = learn()
        prior = math.log((sum(p) + 0.1) / (len(p) - sum(p) + 0.9))
    return odds()


def test_bayes_matches_brute_force(spark):
    blocked, allowed = ["win casino", "free pills"], ["river art", "art news"]
    urls = ["http://casino.a.org/x/win", "http://pills.art.org/", "http://river.b.org/news/x", "http://river.b.org/news/x?2", "http://new.place.org/win/win", "http://new.place.com/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["tokens"], r["log_odds"]) for r in url_filter.judge(pages, {}, blocked, allowed, rounds=3).collect()}
    sites = list(dict.fromkeys(tuple(t) for t, _ in got.values()))
    want = dict(zip(sites, bayes_brute(sites, blocked, allowed, 3), strict=True))
    assert all(abs(want[tuple(t)] - x) < 1e-6 for t, x in got.values()) and len(sites) == 5


@pytest.mark.parametrize("words", [" ".join(url_filter.BLOCKED_SEED).split(), "museum library nature garden".split()])
def test_tables_of_one_site_or_of_equal_rows(spark, words):
    url = f"http://{words[0]}.net/" + "/".join(words * 3)
    for n in (1, 5):
        out = url_filter.judge(spark.createDataFrame([(k, url) for k in range(n)], "page_id long, url string"), {}).collect()
        assert len(out) == n and {r["verdict"] for r in out} == {"block" if words[0] == "online" else "allow"} and all(math.isfinite(r["log_odds"]) for r in out)


def test_letters_that_mean_nothing_leave_the_prior(spark):
    pages = spark.createDataFrame([(0, "http://abcdefghijklmnop.example.org/"), (1, "http://news.example.org/")], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge(pages, {}).collect()} == {"allow"}


def test_labels_and_words_of_any_length(spark):
    """A label of 300,000 letters; words longer than what substrings are cut to, found within labels and not."""
    word = "abcdefghij" * 9
    urls = [f"http://{'river' * 60_000}.example.org/", f"http://casino{word}news.example.org/{word}", f"http://{word[:70]}.example.org/casino", f"http://x.example.org/{word}/{word}"]
    out = {r["page_id"]: r["tokens"] for r in url_filter.judge(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), {}).collect()}
    assert out[0][:-2] == ["river"] * 60_000 and out[1][:3] == ["casino", word, "news"] and out[2][0] == word[:70]


def test_hot_sites_alone_are_repeated(spark):
    hot = [(k, "http://hot.example.org/") for k in range(90)]
    pages = spark.createDataFrame(hot + [(100 + k, f"http://h{chr(97 + k)}.example.org/") for k in range(10)], "page_id long, url string")
    out = url_filter.judge(pages, {}, salts=8).collect()
    assert sorted(r["page_id"] for r in out) == sorted([*range(90), *range(100, 110)])


def test_names_that_stand_on_no_list(spark):
    """A word of no list is learnt from the sites that it stands on beside words of the seed; held-back harmless names stay allowed."""
    spam = [f"zorgplay-{w}" for w in ("casino", "poker", "slots", "jackpot", "bonus")]
    fine = [f"milltown-{w}" for w in ("news", "library", "school", "museum", "garden")] + [f"plain{k}" for k in "abcdefghijklmnopqrstuvwxyz"]
    hosts = [*spam, *fine, "zorgplay-hub", "milltown-hub", "zorgplayhub"]
    pages = spark.createDataFrame([(k, f"http://{h}.example.org/en/{k}") for k, h in enumerate(hosts)], "page_id long, url string")
    got = {hosts[r["page_id"]]: r["verdict"] for r in url_filter.judge(pages, {}).collect()}
    assert {h for h, v in got.items() if v == "block"} == {*spam, "zorgplay-hub", "zorgplayhub"}


def test_sites_of_the_tables(spark):
    """None of these hosts is in the seed; those that general words give away are blocked, the others aren't."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages, {}).select("host", "verdict").distinct().collect()}
    named = {h for h in got if "-" in h}
    assert all(got[h] == "allow" for h in got if h not in named)
    assert sum(got[h] == "block" for h in named) >= 4


def test_urls_of_odd_rows(spark):
    long = "http://" + "a" * 3000 + ".example.org/" + "b" * 50_000
    rows = [(None, "http://casino.example.net/"), (1, None), (1, None), (2, long), (3, "http://Bücher.example.org/straße/日本"), (4, "http://h4ck.example.org/1")]
    pages = spark.createDataFrame([(*r, "x", "y", "z", 0) for r in rows], "page_id long, url string, site string, tokens string, rule string, salt int")
    out = url_filter.judge(pages, RULES).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0) for r in out) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    by = {r["page_id"]: r for r in out}
    assert by[None]["verdict"] == "block" and by[1]["host"] == "" and "straße" in by[3]["tokens"] and by[3]["tokens"][0] == "bücher"


def test_replies_of_the_next_conversation(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "A"), (0, 2, "user", "more"), (0, 3, "assistant", "B"), (1, 0, "user", "yo"), (1, 1, "assistant", "C"), (1, 1, "assistant", "D"), (2, 0, "user", "no reply"), (2**62 + 1, 0, "assistant", "E"), (2**62 + 2, 5, "assistant", "F"), (2**63 - 1, 0, "assistant", "G"), (-(2**63), 0, "assistant", "H"), (None, 0, "user", "lost"), (0, 3, "assistant", "B")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, side string")
    out = {r["pair_id"]: r for r in chat.preference_examples(chat.preference_segments(chat.other_replies(table))).collect()}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    told = {k: (r["prompt"], r["chosen"], r["rejected"]) for k, r in out.items()}
    assert told[0] == (say("user", "hi") + say("assistant", "A") + say("user", "more"), say("assistant", "B"), say("assistant", "D"))
    assert told[1] == (say("user", "yo"), say("assistant", "C") + say("assistant", "D"), "")
    assert told[2] == (say("user", "no reply"), "", "")
    assert told[2**62 + 1] == ("", say("assistant", "E"), say("assistant", "F"))
    assert told[2**63 - 1][2] == "" and told[-(2**63)][2] == "" and len(told) == 7
    assert out[0]["rejected_mask"] == f"{len('<|assistant|>') + 1}-{len(say('assistant', 'D'))}"


def test_preferences_share_their_prompts(spark):
    import duckdb

    from polarmesh.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = queries.op5_chat_formatting(spark, folder).collect()
    assert sum(r["prompt"] != "" for r in rows) > 0.9 * len(rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    columns = ["pair_id", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    want = duckdb.sql(queries.ORACLE_SQL["op5_chat_formatting"]).fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(want)


def test_a_very_long_conversation(spark):
    long = spark.range(20_000).select(F.lit(3).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), "id").alias("text"))
    segments = chat.preference_segments(chat.other_replies(long))
    assert segments.where("part = 'prompt'").count() == 19_999 and segments.where("part = 'chosen'").count() == 1


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "A"), (1, 0, "user", "hi"), (1, 1, "assistant", "B"), (1, 2, "user", None), (1, 2, "user", None), (1, 3, "assistant", "long" * 9), (2, 0, "user", "solo"), (None, 0, "user", "lost"), (4, None, None, "x"), (5, None, None, "x"), (5, 7, "assistant", "end")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, part string")
    out = {r["pair_id"]: r for r in chat.preference_examples(chat.preference_segments(chat.messages_of_pairs(table, chat.consecutive_pairs(table)))).collect()}
    assert set(out) == {0, 1, 2}
    first = out[0]
    assert first["prompt"] == "<|user|>\nhi<|end|>\n"
    assert first["chosen"] == "<|assistant|>\nA<|end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in first["rejected_mask"].split(",")]
    assert [first["rejected"][a:b] for a, b in spans] == ["B<|end|>\n", "long" * 9 + "<|end|>\n"]
    assert out[1]["chosen"] and out[1]["rejected"] == "" and out[1]["prompt"] == ""
    assert out[2]["prompt"] == "<|unknown|>\nx<|end|>\n" and out[2]["chosen"] == "" and out[2]["rejected_mask"]
    assert chat.preference_examples(chat.preference_segments(chat.messages_of_pairs(table.limit(0), chat.consecutive_pairs(table.limit(0))))).count() == 0
