"""Main text by numbers where pages carry no marks, and costs that follow the page."""

import re
import time
from html.parser import HTMLParser

from fathom.llm.html_text import FEATURES, LABELLED, main_text, trained_tree


def without_marks(page):
    """The page with structure elements made ``div`` and class, id, role and item properties gone."""
    page = re.sub(r"(</?)(?:article|nav|header|footer|aside|section|main|form)(?=[\s>/])", r"\1div", page, flags=re.IGNORECASE)
    return re.sub(r"""\s(?:class|id|role|itemprop)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_numbers_decide_on_pages_without_marks(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").where("html <> ''").collect()]
    marked, bare = [main_text(p) for p in pages], [main_text(without_marks(p)) for p in pages]
    words = lambda x: set(x.split())
    same = sum(a == b for a, b in zip(marked, bare)) / len(pages)
    lost = sum(len(words(a) - words(b)) / max(1, len(words(a))) for a, b in zip(marked, bare)) / len(pages)
    added = sum(len(words(b) - words(a)) / max(1, len(words(a))) for a, b in zip(marked, bare)) / len(pages)
    assert same > 0.95 and lost < 0.01 and added < 0.01


def test_tree_uses_words_and_links_of_neighbours():
    used = set()

    def walk(tree):
        if not isinstance(tree, int):
            used.add(FEATURES[tree[0]])
            walk(tree[2]), walk(tree[3])

    walk(trained_tree())
    assert {"words", "links"} <= used and used & {"words_before", "links_before", "words_after", "links_after"}
    assert len(LABELLED) < 200 and all(len(row) == len(FEATURES) + 1 for row in LABELLED)


def test_bare_pages():
    body, more = "word " * 40, "text " * 30
    menu = "<div>" + "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(6)) + "</div>"
    page = f"{menu}<div>Buy our new things today</div><h1>The title</h1><p>{body}</p><p>Short one.</p><p>{more}</p><div>(c) us and them</div>"
    assert main_text(page) == f"The title {body}Short one. {more}".strip()
    assert main_text(f"{menu}<div>{body}</div>{menu}") == body.strip()


def test_deep_nesting_takes_linear_time():
    n = 20_000
    for page in ("<div>" * n + "</section>" * n, "<p><div>" + "<span>" * n + "</p>" * n, "<div class=sidebar>" * n + "<article>" * n, "<a>" * n + "</a>" * n, "<li>" * n):
        began = time.perf_counter()
        assert main_text(page) == ""
        assert time.perf_counter() - began < 10


class Article(HTMLParser):
    """Text of article elements by the parser of the standard library, without parts of other kinds."""

    OTHER = {"script", "style", "nav", "aside", "footer", "form", "figure", "button", "iframe", "noscript"}
    BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "blockquote", "pre", "table", "tr", "td", "section", "article", "header", "footer", "aside", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.other = 0
        self.said = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.other += tag in self.OTHER
        if tag in self.BLOCK:
            self.said.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.other -= tag in self.OTHER
        if tag in self.BLOCK:
            self.said.append(" ")

    def handle_data(self, data):
        if self.inside and not self.other:
            self.said.append(data)


def test_given_pages_equal_an_independent_parser(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null").collect()]
    same = 0
    for page in pages:
        parser = Article()
        parser.feed(page)
        parser.close()
        same += main_text(page) == " ".join("".join(parser.said).split())
    assert same >= 0.99 * len(pages) and len(pages) > 40


def test_pages_without_paragraph_tags(spark, sf_dir):
    """Also with headings and paragraphs made div: nearly no text is lost, and little is added."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").where("html <> ''").collect()]
    bare = [re.sub(r"(</?)(?:p|h[1-6]|li)(?=[\s>/])", r"\1div", without_marks(p), flags=re.IGNORECASE) for p in pages]
    words = lambda x: set(x.split())
    pairs = [(words(main_text(p)), words(main_text(b))) for p, b in zip(pages, bare)]
    every = sum(len(a) for a, _ in pairs)
    assert sum(len(a - b) for a, b in pairs) < 0.02 * every and sum(len(b - a) for a, b in pairs) < 0.06 * every


def test_readers_teasers_calls_and_short_pages():
    body = "word " * 60
    linked = f"<p><a href=x>{'link ' * 9}</a> more</p>"
    comments = f"<h3>Comments</h3><p>I like it very much indeed.</p><h3>3 replies</h3><p>{'reply ' * 30}</p>"
    assert main_text(f"<p>A short first word here.</p>{linked}{comments}") == "A short first word here."
    assert main_text(f"<h1>Title</h1><p>{body}</p><p>Short one.</p>{linked}{comments}") == f"Title {body}Short one."
    assert main_text(f"<div><h1>Title</h1><p>{body}</p><div>{comments}</div><p>{body}</p></div>") == f"Title {body}{body}".strip()
    few = " ".join("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split())
    assert main_text(f"<html><body>{few}</body></html>") == few
    assert main_text(f"<article><h1>Title</h1><p>{body}</p><div class='user-feedback'><p>{'letter ' * 20}</p></div></article>") == f"Title {body}".strip()
    assert main_text(f"<article><h1>Title</h1><p>{body}</p></article><article class='card'><h2>Other</h2><p>words of another story</p></article>") == f"Title {body}".strip()
    assert main_text(f"<article>{body}</article><article>{body}</article>") == f"{body}{body}".strip()
    assert main_text(f"<main><h1>Title</h1><p>{body}</p><p>Subscribe to our letter today.</p></main>") == f"Title {body}".strip()
    assert main_text(f"<main><h1>Comments on a law</h1><p>{body}</p></main>") == f"Comments on a law {body}".strip()
