"""Line-block extraction against a plain version on well-formed pages, on pages without marks, and on hostile ones."""

import time
from html.parser import HTMLParser

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import html_extract as H

SF = "/root/testdata/sf0.001"
PROSE = "Here stand words of prose that run on for more than a line of text. "
LINKS = "<ul><li><a href=a>Home</a></li><li><a href=b>About</a></li><li><a href=c>Contact</a></li></ul>"


class Plain(HTMLParser):
    """Lines of a well-formed page as [text, characters outside links, furniture, in an article or main element]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.open, self.now = [], [], ["", "", False, False]

    def cut(self):
        text = " ".join(self.now[0].split())
        if text:
            self.lines.append((text, max(0, len(text) - len(self.now[1])), self.furniture(), any(t in ("article", "main") for t, _ in self.open)))
        self.now = ["", "", False, False]

    def furniture(self):
        for tag, names in self.open:
            if tag in H.FURNITURE_TAGS and tag != "header":
                return True
            if set(names) & {"ad", "site-footer", "comment-list", "cookie-notice"} or "share" in names and tag != "p":
                return True
            if tag == "header" and not (any(t == "h1" for t, _ in self.open) and any(t == "article" for t, _ in self.open)):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.cut()
        self.open.append((tag, dict(attrs).get("class", "").split()))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        if any(t in ("script", "style", "title") for t, _ in self.open):
            return
        self.now[0] += data
        if any(t == "a" for t, _ in self.open):
            self.now[1] += data.strip()


def plain_text(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.cut()
    weights = [0 if furniture else 3 * own + len(text) if marked else own for text, own, furniture, marked in parser.lines]
    blocks = [sum(weights[i : i + 3]) for i in range(len(weights))]
    kept, best, run = [], (0, 0), []
    for i in range(len(weights) + 1):
        if i < len(weights) and blocks[i] > 0 and (run or weights[i] > 0):
            run.append(i)
        elif run:
            if max(blocks[j] for j in run) >= H.SURGE:
                kept += run
            best = max(best, (sum(weights[j] for j in run), -run[0]))
            last, run = run, []
            if best == (sum(weights[j] for j in last), -last[0]):
                heaviest = last
    kept = kept or (heaviest if best[0] else [])
    return "\n".join(parser.lines[i][0] for i in range(kept[0], kept[-1] + 1) if not parser.lines[i][2]) if kept else ""


leaf = st.sampled_from(["a", "some words", PROSE, PROSE * 2, "x &amp; y", "<a href=u>a link</a>", "<b>bold</b> text", "<a href=u>" + PROSE + "</a>"])
para = st.tuples(st.sampled_from(["<p>%s</p>", "<div>%s</div>", "<li>%s</li>", '<p class="share">%s</p>', '<div class="share">%s</div>', '<p class="notice-of-meeting">%s</p>', '<div class="ad">%s</div>', "<h1>%s</h1>"]), leaf).map(lambda x: x[0] % x[1])
box = st.tuples(st.sampled_from(["<div>%s</div>", "<article>%s</article>", "<nav>%s</nav>", "<footer>%s</footer>", '<div class="site-footer">%s</div>', '<section class="comment-list">%s</section>', "<header>%s</header>", "<main>%s</main>"]), st.lists(para, max_size=6)).map(lambda x: x[0] % "".join(x[1]))


@given(st.lists(box | para, max_size=9).map("".join))
@settings(max_examples=500, deadline=None)
def test_equals_plain_version_on_well_formed_pages(page):
    assert H.main_text(page) == plain_text(page)


def test_equals_plain_version_on_the_pages_of_the_tables():
    pages = [h.split("</article>")[0] + "</article></body></html>" for (h,) in duckdb.sql(f"select html from '{SF}/pages.parquet'").fetchall() if "</article>" in h]
    pages = [p.replace('<meta charset="utf-8">', "").replace("<br>", " ").replace("<p><b>", "<p>") for p in pages]
    assert pages and all(H.main_text(p) == plain_text(p) for p in pages)


#: (page, text) without article, main or any name that tells furniture.
UNMARKED = [
    ("<div>My site</div>" + LINKS + f"<div><p>{PROSE}</p><p>{PROSE}</p><p>End.</p></div>" + LINKS + "<div>Copyright</div>", f"{PROSE.strip()}\n{PROSE.strip()}\nEnd."),
    ("<table><tr><td>News</td></tr></table>" + LINKS + f"<table><tr><td>{PROSE}</td></tr><tr><td>{PROSE}</td></tr></table>" + LINKS + "<p>Call us</p>", f"{PROSE.strip()}\n{PROSE.strip()}"),
    (LINKS * 5 + f"<p>{PROSE * 3}</p>" + LINKS * 5, (PROSE * 3).strip()),
    ("<p>Weather: sun</p>" + LINKS + "<p>" + "</p><p>".join(["Short lines too", "make up a text", "when many of them", "stand side by side", "in one run of lines"]) + "</p>" + LINKS + "<p>Imprint</p>", "Short lines too\nmake up a text\nwhen many of them\nstand side by side\nin one run of lines"),
]


@pytest.mark.parametrize("page,text", UNMARKED)
def test_windows_decide_on_pages_without_marks(page, text, monkeypatch):
    assert H.main_text(page) == plain_text(page) == text
    monkeypatch.setattr(H, "_runs", lambda weights, sums: [(0, len(weights))])
    assert H.main_text(page) != text


@pytest.mark.parametrize("extra", ['<div class="notice-of-meeting">Meeting at noon</div>', '<p class="social">Social life</p>', '<div class="advertising-law-history">Laws</div>', '<p class="related">Kin</p>'])
def test_names_of_prose_stay(extra):
    inside = extra.split(">")[1].split("<")[0]
    assert H.main_text(f"<article><p>{PROSE}</p>{extra}<p>end</p></article>") == f"{PROSE.strip()}\n{inside}\nend"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "topAd", "cookie-notice", "site-footer", "page comments", "comment_list", "main-menu", "sidebar2", "related-posts"])
def test_names_of_furniture_go(name):
    assert H.main_text(f'<article><p>{PROSE}</p><div class="{name}"><p>{PROSE}</p></div><p>end</p></article>') == f"{PROSE.strip()}\nend"


def test_sibling_articles_stay():
    assert H.main_text("<article><p>one long text here</p></article><article><p>two text here also main</p></article>") == "one long text here\ntwo text here also main"


HOSTILE = ["<a ", "<p>hi</p><a ", "<!x ", "<", "</script ", "<script>x</script ", "<!-- ", '<a x=">"', "<div>", "</p></b>", "<p class=", "<p class=\"a b\" id='x", "<p>a", "&amp;&#x;&lt", "<ul><li>", "class "]


@pytest.mark.parametrize("piece", HOSTILE)
@pytest.mark.parametrize("end", ["", ">"])
def test_hostile_pages_take_linear_time(piece, end):
    page = "<div>" * 50_000 * (piece == "</p></b>") + piece * (1_000_000 // len(piece)) + end
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 5
