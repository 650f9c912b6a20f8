"""Page extraction: a plain reader over every page of a table, cases by hand, and time linear in the page."""

import statistics
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrane.llm import html_extract

PAGES = "/root/testdata/sf0.01/pages.parquet"


class PlainReader(HTMLParser):
    """Text nodes as (path of (name, class), block, text); paragraphs end where blocks begin, as in browsers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.nodes, self.block, self.articles = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCKS:
            self.block += 1
            names = [e[0] for e in self.stack]
            if "p" in names:
                at = len(names) - 1 - names[::-1].index("p")
                if not set(names[at + 1 :]) & {"ul", "ol", "div", "article", "section", "nav", "footer"}:
                    del self.stack[at:]
        if tag == "br":
            self.nodes.append((tuple(self.stack), self.block, " "))
        elif tag not in html_extract.VOID:
            self.articles += tag == "article"
            self.stack.append((tag, dict(attrs).get("class") or "", self.articles if tag == "article" else 0))

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCKS:
            self.block += 1
        names = [e[0] for e in self.stack]
        if tag in names:
            del self.stack[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.nodes.append((tuple(self.stack), self.block, data))


def plain_extract(html):
    reader = PlainReader()
    reader.feed(html)
    reader.close()
    gone = {"nav", "footer", "script", "style", "title", "head"}
    nodes = [n for n in reader.nodes if not gone & {e[0] for e in n[0]}]
    real = [n for n in nodes if n[2].strip()]
    path = lambda n: tuple(e[:2] for e in n[0])
    ratio = {}
    for p in {path(n) for n in real}:
        texts = [n[2] for n in real if path(n) == p]
        ratio[p] = (sum(map(len, texts)) / len(texts), sum(t.count(c) for t in texts for c in ".,;:!?") / len(texts))
    score = {}
    for p in ratio:
        fused = []
        for i, n in enumerate(real):
            if path(n) == p:
                near = [ratio[path(m)] for m in real[max(0, i - 1) : i + 2]]
                own = [(ratio[p][k] + statistics.fmean(x[k] for x in near)) / 2 for k in (0, 1)]
                fused.append(own[0] * (own[1] + 0.05))
        score[p] = statistics.fmean(fused)
    threshold = 0.3 * statistics.pstdev(score.values())
    low = {p for p in score if any(c == "ad" for _, c in p) and 0.05 * score[p] < threshold}
    chosen = [n for n in real if path(n) not in low and score[path(n)] >= threshold]
    articles = {e for n in chosen for e in n[0] if e[0] == "article"}
    blocks = {}
    for n in nodes:
        if path(n) not in low and articles & set(n[0]):
            blocks.setdefault(n[1], []).append(n[2])
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def test_every_page_of_a_table(spark):
    pages = pq.read_table(PAGES).to_pylist()
    got = {r.page_id: r for r in html_extract.extract_main_text(spark.read.parquet(PAGES)).collect()}
    assert len(got) == len(pages) > 200
    for p in pages:
        r = got[p["page_id"]]
        assert r.text == plain_extract(p["html"] or "") and r.n_chars == len(r.text) and r.url == p["url"]
        assert len(r.text) > 0


LONG = "This is a long sentence, with commas, and more words, so that it counts as prose. " * 6


def page(extra, around="article"):
    return f"<body><header><p>Site, of all sites.</p></header><nav><a href=x>Home</a></nav><{around}><h1>Title</h1><p>{LONG}</p>{extra}<p>{LONG}</p></{around}><footer>foot</footer></body>"


STAY = [
    '<h2 class="section-header">WORD</h2>', '<div class="chapter-header"><h2>WORD</h2></div>', '<section class="related-work"><p>WORD it.</p></section>', '<div class="legal-analysis"><p>WORD it.</p></div>',
    '<div class="social-history"><p>WORD</p></div>', "<p title=don't>It's WORD text.</p>", "<p data-x=\"a>b\">WORD</p>", "<ul><li>WORD</li></ul>", "<table><tr><td>WORD<td>x</table>", "<p>WORD", 
    "<blockquote>WORD, he said.</blockquote>", "<p>a &lt;b&gt; WORD</p>", "<p class=>WORD</p>", "<p class='x\">WORD</p>",
]
GO = [
    '<p class="advert">WORD now, buy!</p>', '<p class="notice">WORD this notice, please.</p>', f'<div class="comments"><div class="comment"><p>WORD {LONG}</p></div></div>', '<ul class="menu"><li>WORD</li></ul>',
    '<div class="adSlot top"><p>WORD, now.</p></div>', "<aside>WORD</aside>", "<form><label>WORD</label></form>", "<div role=navigation>WORD</div>", "<p hidden>WORD</p>", "<p style='display: none'>WORD</p>",
    "<!-- WORD -->", "<script>WORD</script>", "<style>WORD", '<div class="cookie-banner"><p>WORD, we use.</p></div>', '<div id="related-posts"><p>WORD.</p></div>',
]


@pytest.mark.parametrize("around", ["article", "div", "main"])
def test_what_stays_and_what_goes(around):
    for extra in STAY:
        assert "WORD" in html_extract.extract(page(extra, around)), extra
    assert ("WORD" in html_extract.extract(page("<header><p>WORD</p></header>", around))) == (around != "div")
    for extra in GO:
        text = html_extract.extract(page(extra, around))
        assert "WORD" not in text and text.startswith("Title\n"), extra
    assert html_extract.extract(page("", around)) == f"Title\n{LONG.strip()}\n{LONG.strip()}"


def test_class_names_do_not_decide():
    text = f"<body><div class='sidebar'><p>{LONG}</p><p>Short.</p></div></body>"
    assert html_extract.extract(text) == f"{LONG.strip()}\nShort."
    assert html_extract.furniture_words("site-footer", True) and not html_extract.furniture_words("section-header", False)
    assert html_extract.furniture_words("siteHeader", False) and html_extract.furniture_words("x commentList", True) and not html_extract.furniture_words("", False)


def test_two_articles_and_prose_without_any():
    both = html_extract.extract(f"<body><article><p>{LONG}</p></article><div>Between, not of it.</div><article><p>{LONG}2</p></article></body>")
    assert both == f"{LONG.strip()}\n{LONG.strip()} 2"
    assert html_extract.extract(f"<body><div><p>{LONG}</p></div><div><p>{LONG}</p></div></body>").count("\n") == 1


@pytest.mark.parametrize("unit", ["<b>x ", "</b>", "<p>x", "<script>", "<div><p>", "<a href='", "<i", "x<", "&", "<p class=\"ad", "<li>a<ul>", "<!--", "<article>y "])
def test_time_is_linear(unit):
    def seconds(n):
        began = time.process_time()
        html_extract.extract("<p>" + unit * n)
        return time.process_time() - began

    assert seconds(100_000) < 10


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<p>{LONG}"), (3, "u", "no tags"), (3, "u", "no tags"), (4, "u", " \n "), (5, "u", "<p>" + "w " * 500_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = html_extract.extract_main_text(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, len(LONG) - 1), (1, 0), (2, 0), (3, 7), (3, 7), (4, 0), (5, 999_999)]
    assert html_extract.extract_main_text(df.limit(0)).count() == 0
