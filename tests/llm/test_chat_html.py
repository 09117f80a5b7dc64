import os
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from keystrata.llm import chat, html, html_model, queries

TURNS = "conv_id long, turn long, role string, text string, spans string"
NASTY = ["", "###", "####", "\\", "\\h", "\\\\t", "</turn>", "###</turn>\\", "\n### user: x</turn>\n", "### Assistant: </turn> ok", "a\nb", "é\U0001f600", "</turn", "#", "##"]


def test_round_trip_of_control_strings():
    r = random.Random(1)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "a:b", "", "x</turn>", "\\c"]), "".join(r.choices(NASTY, k=r.randrange(4)))) for _ in range(r.randrange(6))]
        formatted, spans, rewrites = chat.locate(chat.render_default, turns)
        assert chat.parse_default(formatted) == turns and not rewrites
        assert [chat.unescape(formatted[c:d]) for _, _, c, d in spans] == [t for _, t in turns]
        assert "".join(formatted[a:b] for a, b, _, _ in spans) == formatted


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "hi"), ("assistant", "yo"), ("user", "bye")]
    last_only = lambda ts: "".join(f"[{r}]{t if i == len(ts) - 1 else '...'}" for i, (r, t) in enumerate(ts))
    closing = lambda ts: "".join(f"<{r}>{t}" for r, t in ts) + "<end>"
    assert chat.locate(last_only, turns)[2] and chat.locate(closing, turns)[2]
    prefix = lambda ts: "<bos>" + "".join(f"<{r}>{t}<eot>" for r, t in ts)
    formatted, spans, rewrites = chat.locate(prefix, turns)
    assert not rewrites and [formatted[c:d] for _, _, c, d in spans] == ["hi", "yo", "bye"]


def test_loss_covers_assistant_texts_only(spark):
    rows = [(1, 2, "assistant", "b</turn>", None), (1, 1, "user", "a", None), (2, None, None, None, None), (None, 1, "assistant", "x", None), (3, 1, "assistant", "same", None), (3, 1, "assistant", "same", None)]
    out = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    assert (out[1].n_turns, out[1].loss_chars) == (2, len("b</turn>"))
    assert (out[2].n_turns, out[2].loss_chars, out[2].formatted_chars) == (1, 0, len("### : </turn>\n"))
    assert out[None].loss_chars == 1 and out[3].n_turns == 2 and out[3].loss_chars == 8
    rewriting = chat.format_chats(spark.createDataFrame(rows[:2], TURNS), render=lambda ts: "|".join(t for _, t in ts) + "!").first()
    assert rewriting.rewrites and not any(s.loss for s in rewriting.spans)
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="with-sidebar">
<header><h1>Site</h1><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies. <button>OK</button></div><div class="ad">Buy this now, it is a very long advert. Really.</div>
<{0}><h1>Title &amp; more</h1><p>First   para&nbsp;graph with <a href="x">a link</a> in it, long enough.<br>Next line.<p>Second, unclosed &lt;b&gt; and 1 < 2.
<ul><li>One item of a list.<li>Two</ul><blockquote>Quoted words.</blockquote><aside>Aside text</aside><div class="share-links"><a href=q>Share</a></div></{1}>
<section id="comments"><h2>Comments</h2><p>I really liked this long article, thank you. It was good.</p></section>
<form><label>Mail</label><input name=m><p>Subscribe to our letter today.</p></form><aside class="sidebar"><p>Related: a long teaser of another text. Read it.</p></aside>
<footer><p>&copy; 2024 A company with a long legal text. All rights reserved.</p></footer><!-- gone --></body></html>"""
WANT = "Title & more\n\nFirst para graph with a link in it, long enough. Next line.\n\nSecond, unclosed <b> and 1 < 2.\n\nOne item of a list.\n\nTwo\n\nQuoted words."


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-content"', 'div id="story"', "div"])
def test_main_text(tag):
    assert html.extract(PAGE.replace("{0}", tag).replace("{1}", tag.split()[0])) == WANT


def test_broken_pages():
    assert html.extract("") == "" and html.extract("<p") == "" and html.extract("<!-- open <p>x") == ""
    text = "A whole page of plain text without any markup at all, and it goes on for quite a while, as it should."
    assert html.extract(text) == text
    assert html.extract("<article><p>" + "x < y & z. " * 40) == ("x < y & z. " * 40).strip()
    html.extract("<" * 20_000 + '"' * 20_000)
    html.extract("<div>" * 3000 + "<p>deep text, long enough to be kept. Yes it is.")
    html.extract("<a href='" * 3000)


class Article(HTMLParser):
    """A plain version for pages whose article element holds the text: its blocks, parsed by the standard library."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.blocks = False, [], []
        self.feed(page)
        self.close()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        self.blocks += [text] if text and self.inside else []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag in html.BLOCK:
            self.flush()
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.parts.append(data)


def test_query_equals_a_plain_version(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op9_html_extraction(spark, sf).collect()}
    want = {r.page_id: (r.url, text := "\n\n".join(Article(r.html).blocks), len(text)) for r in pages}
    assert len(got) == len(pages) and got == want


def test_the_cut_mends_labels():
    """On made-up pages that weren't fitted on, the cut changes labels, and for the better."""
    weights, strength = html_model.fitted()
    alone, cut, changed = 0, 0, 0
    for found, truth in html_model.labelled(range(9000, 9300)):
        one, other = html.evidence(found, weights) > 0, np.array(html.labels(found, weights, strength))
        alone, cut, changed = alone + (one != truth).sum(), cut + (other != truth).sum(), changed + (one != other).sum()
    assert changed > 10 and cut < alone and cut < 0.04 * 300 * 24


@pytest.mark.parametrize("page", ["<b>{n}</i>{n}", "<header>x{n}", "<i><div><b>{n}</i>{n}", "<textarea>{n}", "<li>ab{n}", "<div>ab. cd<p>x<a href=1>y</a>{n}", "<table><tr><td>a{n}", "<p>a</article>{n}"])
def test_long_awkward_pages_take_time_in_proportion(page):
    def made(n: int) -> str:
        return "".join(part * n for part in page.split("{n}"))

    model = html_model.fitted()
    took = []
    for n in (4000, 16_000):
        began = time.process_time()
        html.extract(made(n), model)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.05)


def test_min_cut_is_minimal():
    def cost(labels, u, edges):
        return sum(abs(x) for x, l in zip(u, labels, strict=True) if (x > 0) != l and x) + sum(w for a, b, w in edges if labels[a] != labels[b])

    for seed in range(200):
        r = random.Random(seed)
        n = r.randint(1, 8)
        u = [r.uniform(-1, 1) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 1.2)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6]
        best = min(cost([bool(m >> k & 1) for k in range(n)], u, edges) for m in range(1 << n))
        assert abs(cost(html.min_cut(u, edges), u, edges) - best) < 1e-6


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE.replace("{0}", "article").replace("{1}", "article"), 5), (None, None, None, 5), (3, "v", "", 5), (3, "v", "", 5)], "page_id long, url string, html string, text int")
    out = sorted(html.main_text(pages).collect(), key=repr)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, WANT, len(WANT)), (3, "", 0), (3, "", 0)]
    assert html.main_text(pages.limit(0)).count() == 0
