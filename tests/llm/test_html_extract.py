"""Main text of pages of several make-ups."""

import random
import re
import time
from html.parser import HTMLParser

from quarrygraph.llm import html_extract as H

SHELL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="x1">
<header><h2>Site</h2></header><nav><a href="/">Home</a></nav><div class="ad-box">Buy &amp; save</div>{}<aside>More</aside><div class="cookie notice">We use cookies</div>
<form><p>Subscribe</p></form><section id="comments"><p>First! A long comment by a reader about nothing in particular, really nothing.</p></section><footer><p>&copy; us</p></footer></body></html>"""
TEXT = "Title &amp; more\nA  &lt;b&gt;\xa0c one\ntwo\nlast"


def test_article_and_divs_alike():
    article = "<article><h1>Head&amp;line</h1><p>One <b>bold</b>\n  text&#33; <a href='x>y'>link</a></p><p>Two<br>three<ul><li>four<li>five</ul></article>"
    want = "Head&line\nOne bold text! link\nTwo\nthree\nfour\nfive"
    for body in (article, article.replace("article", "main"), article.replace("<article>", '<div class="post-17 body">').replace("</article>", "</div>")):
        page = SHELL.replace("{}", body)
        assert H.extract(page, H.best_path(H.scores(page))) == want


def test_odd_markup():
    read = lambda page: H.extract(page, H.best_path(H.scores(page)))
    assert read("") == "" and read("<html><body><nav>x</nav></body></html>") == ""
    assert read("plain text, no tags") == "plain text, no tags"
    assert read("<article><p>cut off in <b>the midd") == "cut off in the midd"
    assert read("<article><p>a<p>b</article") == "a\nb"
    assert read("<article><p>a &lt; b && c < d</p><!-- <p>no</p> --><p>e</p></article>") == "a < b && c < d\ne"
    assert read('<body><div class="content no-sidebar"><p>long enough text</p></div><div class="sidebar">x</div></body>') == "long enough text"
    assert read('<article><header class="post-header"><h1>T</h1></header><p>x</p><div class="share">s</div></article>') == "T\nx"
    assert read('<body><div><p title="a > b">x</p></div></body>') == "x"


def test_hosts_vote(spark):
    good = '<html><body><div class="c{}"><p>{}</p></div><div class="rail"><p>{}</p></div></body></html>'
    pages = [(i, f"http://h.example/{i}", good.format(i, "long running text " * 9, "side")) for i in range(5)]
    pages.append((5, "http://h.example/5", good.format(5, "short", "an unusually long side text that would win alone " * 3)))
    pages += [(6, None, None), (7, "http://other/", "<p>alone</p>"), (7, "http://other/", "<p>alone</p>"), (8, "nonsense", ""), (None, "http://h.example/9", good.format(9, "no id", "s"))]
    out = H.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS path", "'y' AS host", "1 AS score")).collect()
    assert len(out) == len(pages)
    by = {r.page_id: r.text for r in out}
    assert by[5] == "short" and by[0].startswith("long running") and by[6] == "" and by[7] == "alone" and by[8] == "" and by[None] == "no id"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.main_texts(none).count() == 0


def test_very_long_and_very_deep_pages():
    page = "<article>" + "<p>word</p>" * 20000 + "</article>"
    assert H.extract(page, H.best_path(H.scores(page))).count("\n") == 19999
    seconds = []
    for depth in (4000, 32000):
        deep = '<div class="c">x' * depth + "<b>" * depth + "</i>" * depth + "<p>y</p>" * depth
        start = time.perf_counter()
        assert H.extract(deep, H.best_path(H.scores(deep))).endswith("\ny")
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 8 * 4 * seconds[0] + 2  # eight times the page; a quadratic walk takes 64 times as long


def test_heading_and_lead_beside_the_body_belong_to_the_article():
    page = '<body><div class="post"><h1>Head</h1><p class="lead">Lead.</p><div class="text"><p>' + "long text " * 40 + '</p></div></div><div class="more"><a href="/">Other things that are linked from here</a></div></body>'
    assert H.main_text(page, None).startswith("Head\nLead.\nlong") and "Other" not in H.main_text(page, None)
    mixed = page.replace('class="more"><a', 'class="more"><p>w</p><a')
    assert "Head" in H.main_text(mixed, None)


class Tree(HTMLParser):
    """A plain element tree of well-formed pages."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = self.now = {"tag": "", "marks": "", "inside": [], "up": None, "path": ()}
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now["inside"].append("\n")
            return
        known = dict(attrs)
        step = ((tag, *sorted(re.sub(r"\d+", "N", known.get("class", "")).split())),) if tag in H._BLOCKS else ()
        new = {"tag": tag, "marks": " ".join(known.get(k, "") for k in ("class", "id", "role")), "inside": [], "up": self.now, "path": self.now["path"] + step}
        self.now["inside"].append(new)
        self.now = new

    def handle_endtag(self, tag):
        self.now = self.now["up"]

    def handle_data(self, data):
        self.now["inside"].append(data)


def plain(pages):
    """Texts of one host's pages: containers scored by a recursive walk, votes added up, the winner's blocks read off the tree."""

    def dropped(x):
        around = x["up"]
        while around and around["tag"] != "article":
            around = around["up"]
        return H._furniture(x["tag"], x["marks"], around is not None)

    def score(x, found, linked=False):
        if x["tag"] and dropped(x):
            return 0.0
        total = 0.0
        for c in x["inside"]:
            if isinstance(c, str):
                total += len(" ".join(c.split())) * (-2.0 if linked or x["tag"] == "a" else 1.0)
            else:
                total += score(c, found, linked or x["tag"] == "a")
        if total and x["tag"] in H._CONTAINERS:
            found[x["path"]] = found.get(x["path"], 0.0) + total * {"article": 1.5, "main": 1.5, "body": 0.8}.get(x["tag"], 1.0)
            total *= 0.999
        return total

    def read(x, path, inside, out):
        inside = inside or x["path"] == path and x["tag"] in H._BLOCKS
        if x["tag"] and dropped(x):
            out.append("\n")
            return
        out.append("\n" if x["tag"] in H._BLOCKS else "")
        for c in x["inside"]:
            if not isinstance(c, str):
                read(c, path, inside, out)
            elif inside or c == "\n":
                out.append(c if c == "\n" else re.sub(r"\s+", " ", c))
        out.append("\n" if x["tag"] in H._BLOCKS else "")

    trees, votes = [Tree(p).top for p in pages], {}
    for t in trees:
        score(t, found := {})
        for p, s in found.items():
            votes[p] = votes.get(p, 0.0) + s
    winner, texts = max(votes, key=votes.get), []
    for t in trees:
        score(t, found := {})
        own = max(found, key=found.get) if found else None
        if found.get(winner, 0) > 0 and not (own[-1][0] in ("article", "main") and found[winner] < 0.5 * found[own]):
            own = winner
        read(t, own, False, out := [])
        texts.append("\n".join(x for x in (" ".join(line.split()) for line in "".join(out).split("\n")) if x))
    return texts


def test_random_pages_against_a_plain_tree(spark):
    rnd = random.Random(12)
    words = "alpha beta &amp; gamma delta &lt;x&gt; d&eacute;j&agrave; epsilon zeta &#8212; eta".split()

    def inline():
        said = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))
        return rnd.choice([said, said, f"<b>{said}</b>", f'<a href="/x">{said}</a>', f"{said}<br>more", f"<i>a <b>{said}</b></i> b"])

    def block(depth):
        kind = rnd.choice(["p", "p", "h2", "ul", "div", "div", "section", "nav", "aside", "article", "blockquote"] if depth < 5 else ["p"])
        marks = rnd.choice(["", "", ' class="post-7 body"', ' class="share"', ' id="comments"', ' class="lead"', ' role="main"'])
        if kind in ("p", "h2"):
            return f"<{kind}{marks}>{inline()} {inline()}</{kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(3)) + "</ul>"
        return f"<{kind}{marks}>" + "\n".join(block(depth + 1) for _ in range(rnd.randint(1, 4))) + f"</{kind}>"

    pages = ["<html><body>" + "".join(block(0) for _ in range(rnd.randint(2, 6))) + "</body></html>" for _ in range(60)]
    rows = [(i, f"https://h{i % 6}.example/{i}", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h in range(6):
        own = [i for i in range(60) if i % 6 == h]
        assert [got[i] for i in own] == plain([pages[i] for i in own])
