"""Pages as sites write them: misleading names around the text, names the model never saw, broken tags."""

import random
import time

import pytest

from tessel.llm import html_text

BLOCKS = ["River floods old town", "The river rose by two metres, the mayor said on Monday.", "Hundreds of people left their homes."]
ARTICLE = f"<article><h1>{BLOCKS[0]}</h1><p>{BLOCKS[1]}</p><p>{BLOCKS[2]}</p></article>"
MAIN = "\n\n".join(BLOCKS)
MENU = '<nav><ul><li><a href="/">Home</a><li><a href="/w">World</a></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Daily News</p></footer>"


@pytest.fixture(scope="module")
def crf():
    return html_text.train()


@pytest.mark.parametrize("body", ['class="has-sidebar"', 'class="single-post comments-open"', 'class="home-header"', 'class="page ads-enabled"', 'class="js no-touch cookie-consent"', 'id="top" class="menu-open"'])
def test_class_words_of_the_body_say_nothing(crf, body):
    for page in (f"<html {body}><body {body}>{MENU}{ARTICLE}{FOOT}</body></html>", f"<body {body}>{ARTICLE}"):
        assert html_text.main_text(page, crf) == MAIN


@pytest.mark.parametrize("wrapper", ["form", 'section class="related-story"', 'div class="comment-free"', 'div class="content-sidebar-wrap"', 'div class="header-main"', 'section class="ad-story"', 'div id="page-footer-wrap"', 'div role="main"'])
def test_wrappers_of_the_article_say_nothing(crf, wrapper):
    end = wrapper.split()[0]
    side = "<aside class='sidebar'><h3>More</h3><p>Read this too.</p></aside>"
    for page in (f"<body>{MENU}<{wrapper}>{ARTICLE}</{end}>{FOOT}", f"<body><{wrapper}>{ARTICLE}</{end}>", f"<body>{MENU}<{wrapper}>{ARTICLE}{side}</{end}>{FOOT}"):
        assert html_text.main_text(page, crf) == MAIN


def test_reader_comments_under_a_form_go(crf):
    page = f'<body>{MENU}{ARTICLE}<div id="respond"><ol><li><p>I live there, it was awful.</p></li><li><p>Stay safe everyone!</p></li></ol></div>{FOOT}'
    assert html_text.main_text(page, crf) == MAIN


def test_an_article_that_is_a_list_stays(crf):
    tips = [f"Tip: do the thing number {k}" for k in range(6)]
    page = f"<body>{MENU}<article><h1>Ten tips</h1><ol>" + "".join(f'<li>Tip: <a href="/{k}">do the thing number {k}</a>' for k in range(6)) + f"</ol></article>{FOOT}"
    assert html_text.main_text(page, crf) == "\n\n".join(["Ten tips", *tips])


#: Names of content, and of what surrounds it, that the generator of training pages doesn't have.
CONTENT = ("c-prose", "mw-parser-output", "td-lorem", "elementor-post", "rte", "story__inner", "zone-a", "articulo", "beitrag", "texte", "yui-b", "gs-x12", "Page__Copy", "blog-copy", "richtext", "col-lg-9", "layout__middle", "jsx-3120", "css-1u9des2", "hentry")


@pytest.mark.parametrize("name", CONTENT)
def test_names_that_were_never_seen(crf, name):
    right = wrong = missed = 0
    rng = random.Random(name)
    for tag in ("div", "section", "article", "main"):
        head = rng.choice(["<h1>A day at the old harbour</h1>", '<div class="hx"><h1>A day at the old harbour</h1></div>'])
        paragraphs = [f"{w} the boats came in before noon, as they had for years, and the buyers stood waiting." for w in ("First", "Then", "Later", "Still", "Again")]
        body = head + "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f'<html><body class="{rng.choice(CONTENT)}"><div class="qq-1">{MENU}</div><div class="{rng.choice(CONTENT)}"><{tag} class="{name}">{body}</{tag}></div>{FOOT}</body></html>'
        got = html_text.main_text(page, crf).split("\n\n")
        want = {"A day at the old harbour", *paragraphs}
        right, wrong, missed = right + len(want & set(got)), wrong + len(set(got) - want), missed + len(want - set(got))
        assert got != [""]
    assert 2 * right / (2 * right + wrong + missed) >= 0.97


@pytest.mark.parametrize("piece", ["<a ", '<p x="', "<!--", "<", "<li><div>", "<p a='", "<div>", "</p", "<script>", "<table><tr>"])
def test_broken_pages_take_linear_time(piece):
    began = time.perf_counter()
    html_text.blocks(piece * 200_000)
    assert time.perf_counter() - began < 8


def test_stray_and_open_quotes(crf):
    page = ARTICLE.replace("<p>", '<p class="a"">', 1)
    assert html_text.main_text(f"<body>{MENU}{page}{FOOT}", crf) == MAIN
    assert [b.text for b in html_text.blocks('<p title="never closed>x</p><p>y</p>')] == []
    assert [b.text for b in html_text.blocks("<p title='a > b'>x</p><p a=b'c>y</p><iframe><p>no</p></iframe>")] == ["x", "y"]
