"""Pages of many shapes, labelled by hand: what stands between [[ and ]] is main text."""

import re

import pytest

from tessel.llm import html_text

HEAD = "<!DOCTYPE html><html><head><meta charset=utf-8><title>River floods town | Daily News</title><style>p{}</style><script>if (a < b) { c('</p>') }</script></head><body>"
MENU = '<nav><ul><li><a href="/">Home</a><li><a href="/w">World</a><li><a href="/s">Sport</a></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Daily News. All rights reserved.</p></footer></body></html>"
STORY = "<h1>[[River floods old town]]</h1><p>[[The river rose by two metres, the mayor said on Monday.]]</p><p>[[Hundreds of people left their homes.]]</p><h2>[[What happens next]]</h2><p>[[More rain is expected, but less than last week.]]</p><p>[[Schools stay closed.]]</p>"
COMMENTS = '<p>I live there, it was awful.</p><p>Stay safe everyone!</p>'


def page(body, menu=MENU, foot=FOOT):
    return HEAD + menu + body + foot


SHAPES = {
    # wrappers
    "article": page(f"<article>{STORY}</article>"),
    "article div": page(f"<article><div>{STORY}</div></article>"),
    "article deep": page(f"<article>{'<div>' * 200}{STORY}{'</div>' * 200}</article>"),
    "main": page(f"<main>{STORY}</main>"),
    "main article section": page(f"<main><article><section>{STORY}</section></article></main>"),
    "sections": page("<article><section><h1>[[River floods]]</h1><p>[[It rose by two metres, they said.]]</p></section><section><h2>[[Later]]</h2><p>[[It fell again.]]</p></section></article>"),
    "div content": page(f'<div class="content">{STORY}</div>'),
    "div entry": page(f'<div id="main" class="entry-content">{STORY}</div>'),
    "bootstrap": page(f'<div class="container"><div class="row"><div class="col-md-8">{STORY}</div></div></div>'),
    "wrapper row col": page(f'<div class="wrapper"><div class="row"><div class="col">{STORY}</div></div></div>'),
    "hashed names": page(f'<div id="root"><div class="css-1ab"><div class="sc-bdVaJa">{STORY}</div></div></div>'),
    "no wrapper": page(STORY),
    "plain div": page(f"<div>{STORY}</div>"),
    "role main": page(f'<div role="main">{STORY}</div>'),
    "layout table": page(f"<table><tr><td>{STORY}</td></tr></table>"),
    "center": page(f"<center>{STORY}</center>"),
    "nothing else": f"<article>{STORY}</article>",
    "header inside": page(f"<article><header><h1>[[River floods old town]]</h1></header><p>[[The river rose, the mayor said.]]</p><p>[[Hundreds left.]]</p></article>"),
    # blocks of the article
    "table": page("<article><h1>[[Levels of the river]]</h1><p>[[These are the levels, by day.]]</p><table><caption>[[Levels by day]]</caption><tr><th>[[Day]]<th>[[Level]]<tr><td>[[Monday]]<td>[[412]]<tr><td>[[Tuesday]]<td>[[398]]</table><p>[[It falls slowly.]]</p></article>"),
    "table closed": page("<main><p>[[These are the levels, by day.]]</p><table><thead><tr><th>[[Day]]</th><th>[[Level]]</th></tr></thead><tbody><tr><td>[[Monday]]</td><td>[[412]]</td></tr></tbody></table><p>[[It falls slowly.]]</p></main>"),
    "figure": page("<article><h1>[[River floods]]</h1><figure><img src=a.png><figcaption>[[The old bridge on Monday.]]</figcaption></figure><p>[[The river rose, the mayor said.]]</p></article>"),
    "lists": page("<article><h1>[[What to pack]]</h1><p>[[Take these things, if you can:]]</p><ul><li>[[Water]]<li>[[A torch and some batteries.]]<li>[[Papers]]</ul><ol><li>[[Leave early.]]</li><li>[[Call us.]]</li></ol></article>"),
    "definitions": page("<article><h1>[[Words of the river]]</h1><dl><dt>[[Crest]]<dd>[[The highest level that it reaches.]]<dt>[[Stage]]<dd>[[The level of the water.]]</dl></article>"),
    "quote": page("<article><h1>[[River floods]]</h1><p>[[The mayor was clear.]]</p><blockquote><p>[[We will build it again, and better.]]</p></blockquote><p>[[Nobody was hurt.]]</p></article>"),
    "code": page("<article><h1>[[How to read the gauge]]</h1><p>[[Run this command on your machine.]]</p><pre>[[curl gauge.example | sort]]</pre><p>[[It prints the level.]]</p></article>"),
    "open tags": page("<article><h1>[[River floods]]</h1><p>[[The river rose, they said.]]<p>[[Hundreds left.]]<p><b>[[Schools stay closed.]]</b><br></article>"),
    "inline": page("<article><h1>[[River <em>floods</em> town]]</h1><p>[[The <a href=/r>river</a> rose &amp; fell,&nbsp;they&#32;said.]]</p></article>"),
    "divs for paragraphs": page('<div class="post"><div>[[The river rose by two metres, the mayor said.]]</div><div>[[Hundreds of people left their homes.]]</div><div>[[Schools stay closed until Friday.]]</div></div>'),
    "long list without ends": page("<article><p>[[All the places, one by one.]]</p><ul>" + "".join(f"<li>[[Place number {k}, near the river.]]" for k in range(80)) + "</ul><p>[[That was all.]]</p></article><section class=comments>" + COMMENTS + "</section>"),
    "rows without ends": page("<article><p>[[All the levels, one by one.]]</p><table>" + "".join(f"<tr><td>[[Day {k}]]<td>[[{k * 7}]]" for k in range(80)) + "</table><p>[[That was all.]]</p></article>"),
    # what goes
    "aside inside": page(f'<article>{STORY}<aside><h3>Read more</h3><p>Ten bridges to see.</p></aside></article>'),
    "nested asides": page(f'<main><article>{STORY}<aside><aside><p>Ten bridges to see.</p></aside></aside></article></main><aside><p>Most read today.</p></aside>'),
    "advert inside": page('<article><h1>[[River floods]]</h1><p>[[It rose by two metres.]]</p><div class="ad">Buy new boots, half price.</div><p>[[Hundreds of people left.]]</p></article>'),
    "sponsored": page(f'<div class="sponsored"><p>Boots, half price today only.</p></div><article>{STORY}</article>'),
    "cookie notice": page(f'<div class="cookie-banner"><p>We use cookies, as all do.</p></div><article>{STORY}</article>'),
    "dialog": page(f"<dialog><p>Get our letter every morning.</p></dialog><main>{STORY}</main>"),
    "newsletter inside": page('<article><h1>[[River floods]]</h1><p>[[It rose by two metres.]]</p><div class="newsletter"><p>Get our letter every morning.</p></div><p>[[Hundreds of people left.]]</p></article>'),
    "form inside": page(f'<article>{STORY}<form action=/s><label>Your name</label><input><button>Send</button></form></article>'),
    "search form": page(f'<form class="search"><label>Search this site</label><input></form><article>{STORY}</article>'),
    "comments outside": page(f'<article>{STORY}</article><section class="comments"><h3>Comments</h3>{COMMENTS}</section>'),
    "comments inside": page(f'<article>{STORY}<div id="comments">{COMMENTS}</div></article>'),
    "comments listed": page(f'<article>{STORY}</article><ol class="comment-list"><li>I live there, it was awful.<li>Stay safe everyone!</ol>'),
    "div menu and footer": page(f'<article>{STORY}</article>', '<div class="header"><h2>Daily News</h2></div><div class="menu"><ul><li><a href=/>Home</a><li><a href=/w>World</a></ul></div>', '<div class="footer"><p>Daily News, Main Street 1.</p></div></body></html>'),
    "header and menu": page(f"<article>{STORY}</article>", f"<header><h1>Daily News</h1><p>All that matters.</p>{MENU}</header>"),
    "sidebar first": page(f'<div class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Ten bridges</a><li><a href=/2>Five dams</a></ul></div><div class="content">{STORY}</div>'),
    "breadcrumbs": page(f'<div class="breadcrumbs"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><main>{STORY}</main>'),
    "related": page(f'<article>{STORY}</article><section class="related"><h3>Related</h3><ul><li><a href=/1>Ten bridges to see</a></ul></section>'),
    # odd markup
    "self-closed svg": page('<article><h1>[[River floods]]</h1><svg width=1/><p>[[It rose by two metres.]]</p><p>[[Hundreds left.]]</p></article>'),
    "math": page('<article><h1>[[The formula]]</h1><p>[[The level is <math><mi>h</mi></math>, in metres.]]</p><p>[[It is simple.]]</p></article>'),
    "object left open": page("<article><h1>[[River floods]]</h1><object data=x><p>[[It rose by two metres.]]</p><p>[[Hundreds left.]]</p></article>"),
    "script between": page("<article><h1>[[River floods]]</h1><script>document.write('<p>no</p>')</script><p>[[It rose by two metres.]]</p><script src=x.js></script><p>[[Hundreds left.]]</p></article>"),
    "script closed itself": page("<article><h1>[[River floods]]</h1><script src=x.js /><p>[[It rose by two metres.]]</p><p>[[Hundreds left.]]</p></article>"),
    "stray ends": page("</div></p><article></section><h1>[[River floods]]</h1></b><p>[[It rose by two metres.]]</p></li><p>[[Hundreds left.]]</p></article>"),
    "upper case": page("<ARTICLE><H1>[[River floods]]</H1><P>[[It rose by two metres.]]<P>[[Hundreds left.]]</ARTICLE>"),
}


@pytest.fixture(scope="module")
def crf():
    return html_text.train()


def split(marked):
    plain = re.sub(r"\[\[|\]\]", "", marked)
    return plain, ["[[" in b.text for b in html_text.blocks(marked)], [b.text for b in html_text.blocks(plain)]


@pytest.mark.parametrize("name", SHAPES)
def test_no_shape_is_empty(crf, name):
    plain, want, texts = split(SHAPES[name])
    got = html_text.main_text(plain, crf)
    assert got and len(want) == len(texts)


def test_blocks_of_all_shapes(crf):
    hit = extra = missed = 0
    for marked in SHAPES.values():
        plain, want, _ = split(marked)
        got = crf.decode(html_text.features(html_text.blocks(plain)))
        hit, extra, missed = hit + sum(a and b for a, b in zip(got, want)), extra + sum(a and not b for a, b in zip(got, want)), missed + sum(b and not a for a, b in zip(got, want))
    assert len(SHAPES) >= 40 and 2 * hit >= 0.98 * (2 * hit + extra + missed)
