import random
from collections import Counter
from itertools import combinations

from tallyforge.llm import html as H

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>One two</b> {}<br><p>Next&nbsp;line   here<script>var x="</p>"</script></article><section class="comments"><p>So bad</p></section><footer>&copy; x</footer></body></html>"""


def blocks(page):
    return H.Page(page).blocks()


def test_blocks():
    assert blocks(PAGE.format("three")) == ["Head & line", "One two three", "Next line here"]
    assert blocks(None) == blocks("") == blocks(" \n ") == []
    assert blocks("plain < 3 &lt; 4 <b>x</b>") == ["plain < 3 < 4 x"]
    assert blocks("<div>" * 5000 + "x") == ["x"]
    assert blocks("<p>a" * 5000) == ["a"] * 5000
    assert blocks("<p>" + "long text " * 200_000) == [("long text " * 200_000).strip()]
    assert blocks("<ul><li><a>one</a><li><a>two</a></ul><p>text <a>link</a></p><h1><a>Head</a></h1>") == ["text link", "Head"]


def test_foreign_and_fallback_content():
    """Only scripts, styles, templates and the like have no text; self-closed foreign elements hold nothing that follows."""
    assert blocks('<p>one</p><svg class="x"/><p>two</p>') == ["one", "two"]
    assert blocks('<p>one <math><mi>x</mi><mo/>=<mn>2</mn></math> so</p><svg><path d="M0"/><text>label</text></svg><p>two</p>') == ["one x=2 so", "label", "two"]
    assert blocks("<p>a</p><noscript><p>still read</p></noscript><object><p>fallback</p></object><p>b</p>") == ["a", "still read", "fallback", "b"]
    assert blocks("<p>a</p><template><p>no</p></template><script>x<svg></script><style>y</style><textarea>z <b></textarea><iframe>w</iframe><p>b</p>") == ["a", "b"]


def test_names_decide_no_paragraph():
    for name in ("navy", "share-price", "reply", "notice-period", "promotion-history", "menu-engels", "related", "widget", "social-history", "comments-on-war", "notices"):
        assert blocks(f'<p>one</p><p class="{name}">two</p><p id="{name}">three</p>') == ["one", "two", "three"], name
    for name in ("navy", "share-price", "notice-period", "promotion-history", "menu-engels", "social-history", "comments-on-war", "headmaster", "adsorption"):
        assert blocks(f'<p>one</p><div class="{name}">two</div>') == ["one", "two"], name
    for name in ("ad", "ads", "site-nav", "mainMenu", "cookie-notice", "share-buttons", "social_links", "related-posts", "comment-list", "newsletter", "sidebar-left", "widget-area", "x comments y"):
        assert blocks(f'<p>one is longer</p><div class="{name}">two</div><p>three</p>') == ["one is longer", "three"], name


NOTICED = '<div class="top"><p>Welcome all readers</p></div><div><h2>On {0}</h2><p>{1}</p></div><div><p>Terms apply here</p></div>'


def test_the_length_of_an_article_decides_nothing(spark):
    """A host has a template or copies, whatever is on one of its pages."""
    short, long = "Short one {0}.", "Dear reader, " + "the matter of {0} is long and takes its time. " * 20
    rows = [(i, "http://n.org/", NOTICED.format(i, (short if i % 2 else long).format(i).strip())) for i in range(6)]
    out = {r.page_id: r.text for r in H.extract(frame(spark, rows)).collect()}
    assert out == {i: f"On {i}\n{(short if i % 2 else long).format(i).strip()}" for i in range(6)}


def test_frames_are_no_boilerplate():
    """Names and tags of elements that hold the article or most of the page say nothing about it."""
    assert blocks('<div class="single comments-open"><p>a</div>') == ["a"]
    assert blocks('<div class="site has-sidebar"><article><p>the text</article><div class="sidebar">x</div></div>') == ["the text"]
    assert blocks('<form id="aspnetForm"><nav>menu</nav><div><p>the text of the page</p></div><footer>f</footer></form>') == ["the text of the page"]
    own, said = "<p>the post is here</p>" * 3, '<article class="comment"><p>so bad it is</p></article>' * 4
    assert blocks(f'<main><article>{own}</article><div class="comments">{said}</div></main>') == ["the post is here"] * 3
    assert blocks(f'<div class="post">{own}</div><div class="comments">{said}</div>') == ["the post is here"] * 3


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, tokens string, support int")


SITE = """<html><body><div id="top"><a href="/">Home</a> Welcome to our site</div><div id="c{0}"><div class="lead">Lead of {0}</div><p>Own text {0} goes on {0} and says a good deal more than what is all around it</p>
<p>All rights are with us, always.</p><p>and on {0}</p><p>Write to the desk.</p></div><div class="xx">s {0}</div></body></html>"""


def test_template_of_a_host(spark):
    rows = [(i, "http://a.org/x", SITE.format(i)) for i in range(6)] + [(10 + i, "http://b.org/", PAGE.format(i)) for i in range(5)]
    rows += [(20, "http://one.org", PAGE.format("alone")), (21, None, None), (22, "http://a.org/y", ""), (23, "http://a.org/x", SITE.format(3)), (23, "http://a.org/x", SITE.format(3)), (None, None, "<p>q")]
    rows += [(30 + i, "http://copies.org/", PAGE.format("copy")) for i in range(4)]
    made = H.extract(frame(spark, rows)).collect()
    out = {(r.page_id, r.text) for r in made}
    # paragraphs that every page has are the template's, though they are unmarked and between the page's own
    assert {(p, f"Lead of {i}\nOwn text {i} goes on {i} and says a good deal more than what is all around it\nand on {i}\ns {i}") for p, i in ((2, 2), (3, 3), (23, 3))} <= out
    assert (12, "Head & line\nOne two 2\nNext line here") in out  # most of it is equal: near copies, no template
    assert (20, "Head & line\nOne two alone\nNext line here") in out
    assert {(30 + i, "Head & line\nOne two copy\nNext line here") for i in range(4)} <= out  # copies are no template
    assert {(21, ""), (22, ""), (None, "q")} <= out
    assert len(made) == len(rows) and all(r.n_chars == len(r.text) for r in made)
    assert H.extract(frame(spark, rows).limit(0)).count() == 0


def site(rng, pages):
    """Pages of one host: common, frequent and own blocks, some of them twice or in another order."""
    fixed = [f"fixed words {k}" for k in range(6)]
    some = [f"often said {k}" for k in range(4)]
    out = []
    for p in range(pages):
        shown = [f for f in fixed] + ([s for s in some] if rng.random() < 0.7 else [])
        if rng.random() < 0.2:
            rng.shuffle(shown)
        body = [b for x in shown for b in (x, *(f"own {rng.random()}" for _ in range(rng.randint(1, 4))))]
        if rng.random() < 0.3:
            body.append(body[0])
        out.append("".join(f'<div class="{rng.choice("ab")}">{b}</div>' if rng.random() < 0.2 else f"<p>{b}</p>" for b in body))
    return out + [out[0], out[1]] * (pages % 2)


def test_deduction_equals_brute_force(spark):
    rng = random.Random(5)
    sites = {f"h{k}.org": site(rng, rng.randint(2, 16)) for k in range(12)}
    rows = [(i, f"http://{name}/{i}", html) for name, pages in sites.items() for i, html in enumerate(pages)]
    found = {}
    for r in H.classes(H.frequent(frame(spark, rows))).collect():
        found.setdefault(r.host, {})[r.token] = ((r.high, r.low), r.support, r.valid, r.place)
    text = {(r.page_id, r.url): r.text for r in H.extract(frame(spark, rows)).collect()}
    dropped = 0
    for name, pages in sites.items():
        parsed = [H.Page(p) for p in pages]
        counts = [Counter(t for t, _, _ in p.parts) for p in parsed]
        vectors = {t: tuple(c[t] for c in counts) for c in counts for t in c}
        often = {t: v for t, v in vectors.items() if sum(map(bool, v)) >= max(H.LEAST_PAGES, H.SUPPORT * len(pages))}
        sized = Counter(often.values())
        got = found.get(name, {})
        assert {t: (sum(map(bool, v)), sized[v] > 1) for t, v in often.items()} == {t: x[1:3] for t, x in got.items()}
        assert all((often[a] == often[b]) == (got[a][0] == got[b][0]) for a, b in combinations(often, 2))
        said = [[(t, " ".join("".join(s for _, s in b).split())) for t, _, b in page.parts if b] for page in parsed]
        valid = {t for t, x in got.items() if x[2]}
        copies = 2 * sum(len(x) for page in said for t, x in page if t in valid) > sum(len(x) for page in said for _, x in page)
        # the template: a longest run of first places, by trying every token before every other
        place = {t: (x[3], t) for t, x in got.items() if x[2]}
        for i, page in enumerate(parsed):
            firsts = list(dict.fromkeys(t for t, _, _ in page.parts if t in place))
            best = [1] * len(firsts)
            for k in range(len(firsts)):
                best[k] = 1 + max((best[j] for j in range(k) if place[firsts[j]] < place[firsts[k]]), default=0)
            run = page.template({t: k for k, t in enumerate(sorted(place, key=place.get))})
            assert len(run) == max(best, default=0) and sorted(run, key=firsts.index) == sorted(run, key=place.get)
            left = [x for t, x in said[i] if t not in run]
            assert text[i, f"http://{name}/{i}"] == "\n".join([x for _, x in said[i]] if copies else left)
            dropped += 0 if copies else len(said[i]) - len(left)
    assert dropped > 50
