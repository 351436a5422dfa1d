"""What the text-to-tag ratio finds by itself, and what names keep out."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from textguard.llm.html_main import main_text

PAGES = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
STORY = "".join(f"<p>Body sentence number {i} of the real story goes on for a while here, really.</p>" for i in range(6))
JUNK = '<div class="%s"><p>Unwanted words that stand in a box of this kind and are long enough.</p></div>'
LINKS = "<ul>" + "".join(f"<li><a href=x>Link to page {i} of the site</a></li>" for i in range(6)) + "</ul>"


def bare(html):
    """Without class, id and role."""
    return re.sub(r"""\s(?:class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", html)


def plain(html):
    """And without the elements that tell what they hold."""
    return re.sub(r"(?i)(</?)(nav|footer|aside|header|article|main|form)\b", r"\1div", bare(html))


def f1(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values())) if x or y else 1.0


@pytest.mark.parametrize("less", [bare, plain])
def test_articles_are_found_without_telling_markup(less):
    found = [f1(main_text(less(p["html"])), main_text(p["html"])) for p in PAGES]
    assert sum(found) / len(found) >= 0.98 and min(found) >= 0.9


@pytest.mark.parametrize("name", ["cookie-banner", "left-sidebar", "ad-slot", "site-footer", "user-comments", "share_bar", "page-header"])
def test_names_that_end_or_begin_with_a_telling_word(name):
    box = JUNK % name
    for page in (f"<body>{box}<div>{STORY}</div>{box}</body>", f"<body><div>{box}{STORY}{box}</div></body>"):
        text = main_text(page)
        assert "Unwanted" not in text and text.count("Body sentence") == 6


@pytest.mark.parametrize("name", ["comment-list", "newsletter-box", "ad-slot"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_boxes_inside_articles(name, tag):
    text = main_text(f"<{tag}>{STORY}{JUNK % name}</{tag}>")
    assert "Unwanted" not in text and text.count("Body sentence") == 6


@pytest.mark.parametrize("name", ["social", "related", "notice"])
def test_paragraphs_of_an_article_stay(name):
    assert "Kept words" in main_text(f'<article><p class="{name}">Kept words of the article itself.</p>{STORY}</article>')
    assert "Kept words" not in main_text(f'<article><p class="ad">Kept words of the article itself.</p>{STORY}</article>')


def test_a_wrapper_of_most_of_the_text_stays():
    assert main_text(f'<body><div class="with-sidebar">{STORY}</div><div>Foot.</div></body>').count("Body sentence") == 6


def test_lists_of_links_and_copyright_lines():
    text = main_text(f"<body>{LINKS}<div>{STORY}{LINKS}</div><p>© 2024 Some Company. All rights reserved.</p></body>")
    assert "Link to" not in text and "rights" not in text and text.count("Body sentence") == 6
    assert "a link" in main_text(f"<body><div>{STORY}<p>Here is <a href=x>a link</a> in a sentence of its own.</p>{STORY}</div></body>")
    assert main_text("<p>© alone</p>") == "© alone" and main_text("<a href=x>only a link</a>") == "only a link"
