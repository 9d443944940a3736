"""Main text of web pages by a linear-chain conditional random field over leaf blocks of the DOM.

A page is cut at block-level tags into leaf blocks. Features are the tags and class names of a block's ancestors, its
own tag, and what its text looks like; the chain has two states, main text and boilerplate. It is trained on labelled
pages that a generator writes (its layouts, tag and class names are the parameters), and pages are decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import tokens
from .bpe import runs
from .common import small_batches

#: Tags that begin and end blocks, and those that have no end.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open tags that a tag ends, as far as the tags at which that stops.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
    "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption", "table"), "thead": ("tbody thead tfoot tr td th caption", "table"), "tfoot": ("tbody thead tfoot tr td th caption", "table"),
}
ENDS = {tag: (frozenset(closed.split()), frozenset(until.split())) for tag, (closed, until) in ENDS.items()}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose text no reader sees; elements whose class words say nothing about a part of the page.
UNSEEN, WHOLE = frozenset("script style iframe noembed noframes".split()), frozenset(("html", "body"))
#: Share of a page's text from which an element that holds a main heading, or any where there is none, is around the page rather than a part of it.
AROUND, AROUND_HEADLESS = 0.3, 0.6


class Node:
    """An open element, with what holds for all elements from the root to it. Of those around the page only the tags count, and apart: their class words tell of layouts."""

    __slots__ = ("tag", "parent", "own", "chars", "heads", "tags", "names", "around", "inner")

    def __init__(self, tag: str, parent: Node | None, attributes: dict):
        self.tag, self.parent, self.chars, self.heads = tag, parent, 0, tag == "h1"
        said = "" if tag in WHOLE else " ".join(attributes.get(a, "") for a in ("class", "id", "role"))
        self.own = frozenset(w.lower() for w in WORDS.findall(said)) if said else frozenset()
        self.tags = self.names = self.around = frozenset()
        self.inner = None

    def place(self, total: int, headed: bool) -> None:
        """Sets what holds from the root on; parents come first, and children have been added up."""
        up, none = self.parent, frozenset()
        up_tags, up_names, up_around, up_inner = (up.tags, up.names, up.around, up.inner) if up else (none, none, none, None)
        holds = self.chars >= AROUND * total if self.heads and headed else not headed and self.chars >= AROUND_HEADLESS * total
        more = lambda known, new: known if new <= known else known | new
        one = frozenset((self.tag,))
        self.tags, self.names, self.around = (up_tags, up_names, more(up_around, one)) if holds and total else (more(up_tags, one), more(up_names, self.own), up_around)
        self.inner = none if self.tag in ("article", "main") else up_inner if up_inner is None else more(up_inner, one)


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    linked: int  # characters of it inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Inline tags count as nothing, line breaks as white space; scripts, styles, comments and attributes are no text, all else is. Ends of elements that HTML lets out are implied."""
    out, run, linked, in_link = [], [], 0, 0
    root = Node("", None, {})
    stack, nodes, depths, unseen = [root], [root], defaultdict(list), False

    def close():
        nonlocal linked
        if run:
            said = " ".join("".join(run).split())
            if said:
                out.append(Block(said, stack[-1], linked))
                stack[-1].chars += len(said)
            run.clear()
        linked = 0

    def cut(depth):
        while len(stack) > depth:
            depths[stack.pop().tag].pop()

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            if not unseen:
                run.append(html.unescape(tag))
                if in_link:
                    linked += len(tag)
            continue
        if tag in UNSEEN:
            unseen = kind == "open"
            continue
        if tag == "a":
            in_link = max(0, in_link + (1 if kind == "open" else -1))
        if tag == "br":
            run.append(" ")
        if tag not in BLOCKS:
            continue
        close()
        if kind == "close":
            if depths[tag]:
                cut(depths[tag][-1])
        elif tag not in VOID:
            if stack[-1].tag == "p":
                cut(len(stack) - 1)
            if tag in ENDS:
                closed, until = ENDS[tag]
                stop = max((depths[t][-1] for t in until if depths[t]), default=0)
                while (at := max((depths[t][-1] for t in closed if depths[t]), default=0)) > stop:
                    cut(at)
            depths[tag].append(len(stack))
            nodes.append(Node(tag, stack[-1], attributes))
            stack.append(nodes[-1])
    close()
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.heads |= node.heads
    for node in nodes:
        node.place(root.chars, root.heads)
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that are on, for each block."""
    out = []
    for b in found:
        n, words, node = len(b.text), b.text.count(" ") + 1, b.node
        f = ["bias", "own=" + node.tag, f"length={min(6, n.bit_length() - 3)}", f"links={min(3, 4 * b.linked // max(1, n))}"]
        f += ["in=" + t for t in node.tags] + ["name=" + w for w in node.names]
        f += ["around=" + t for t in node.around]
        f += ["sentence" if b.text[-1] in ".!?…。\"”»" else "no stop", "comma" if "," in b.text else "no comma"]
        f += ["©"] if "©" in b.text or "(c)" in b.text.lower() else []
        f += ["few words"] if words < 5 else []
        if node.inner is not None:
            f += ["inside"] + ["inside=" + t for t in node.inner]
        out.append(f)
    return out


#: What the generator of labelled pages draws from; ``any`` are wrappers that tell nothing.
LAYOUT = {
    "main": ("article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry"', 'section class="story"', 'div class="article-body"', 'main><article', 'div role="main"', 'article class="post"', 'div class="entry-content"', "", "", 'div class="text"'),
    "any": ("div", "div", 'div class="wrapper"', 'div class="container"', 'div class="row"', 'div class="col"', 'div id="page"', 'div class="inner"', "section", 'div class="col-md-8"', 'div class="layout grid"', 'div id="site"', 'div class="box"', 'div class="block"', 'div class="section"', 'div class="left"', 'div class="body"', 'div class="{}"', 'div id="{}"', 'div class="{} {}"', "center", "table><tr><td"),
    "menu": ("nav", 'div class="menu"', 'div id="nav"', 'ul class="navbar"', 'div class="breadcrumbs"', 'div role="navigation"', 'ol class="breadcrumb"', 'div class="navigation"', 'div class="pagination"', "menu"),
    "top": ("header", 'div class="header"', 'div id="masthead"', 'div class="topbar"', 'div role="banner"', 'div class="site-header"', 'header class="top"', 'div id="top"'),
    "side": ("aside", 'div class="sidebar"', 'div id="sidebar"', 'section class="related"', 'div class="widget"', 'div class="recommended"', 'aside class="related"', 'div role="complementary"', 'div class="trending"', 'div class="side"', 'div class="more"'),
    "advert": ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="promo"', 'div class="sponsored"', 'aside class="advertisement"', 'div id="banner"', 'div class="banner"', 'div class="sponsor"', 'ins class="adsbygoogle"><div class="ad-slot"', 'div class="promotion"', 'section class="ad"', 'p class="ad"'),
    "notice": ('div class="cookie"', 'div class="cookie-notice"', 'div class="notice"', 'div class="consent"', 'div role="alert"', 'div class="newsletter"', "dialog", 'div class="popup"', 'div class="subscribe"', 'div class="alert"', 'div class="gdpr"', 'div class="modal"', 'div class="overlay"', 'div id="cookie-banner"', 'div class="paywall"', 'div role="dialog"', 'p class="notice"'),
    "form": ("form", 'form class="search"', 'form id="login"', 'form class="signup"', 'div class="search"><form', "form><fieldset"),
    "comments": ('div id="respond"', 'div id="respond"><ol', 'div class="commentlist"', 'ol class="comment-list"', 'section class="reader-comments"', 'div class="discussion"', 'section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments"', 'div class="responses"', 'div class="comment"', 'div id="disqus"', 'div class="replies"', 'section id="discussion"', 'div class="feedback"', 'ul class="comments"'),
    "foot": ("footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div role="contentinfo"', 'footer class="site-footer"', 'div class="legal"', 'div id="colophon"'),
    "misled": ('div class="has-{}"', 'div class="no-{}"', 'div class="with-{} {}"', 'section class="{}-story"', 'div class="{}-free"', 'div class="{}-open"', 'div class="{}-enabled"', 'div class="content-{}-wrap"', 'div class="{}-main"', 'div class="js-{} {}-wrapper"', 'div id="{}-page"', "form", 'form id="{}-form"'),
    "word": ("sidebar", "comment", "comments", "header", "ad", "ads", "related", "cookie", "share", "nav", "menu", "footer", "widget", "promo", "search", "social", "tags", "popup", "banner", "notice", "trending", "sponsor", "newsletter", "modal", "more", "side", "top"),
    "share": ('div class="share"', 'ul class="social"', 'div class="tags"', 'p class="byline"'),
}


def labelled_page(rng: random.Random) -> tuple[str, list[bool]]:
    """(a page, whether each of its leaf blocks is main text)."""
    parts, labels = [], []
    para = rng.choice(["p"] * 8 + ["div"])
    junk = rng.choice(["", "", "", "!!", " |", "***", " #", "$$$", ";"])  # some pages are noisy throughout

    def words(a, b):
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwäéñ") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b))).capitalize()

    def sentence(a, b):
        said = words(a, b).split(" ")
        return " ".join(w + ("," if rng.random() < 0.1 and k + 1 < len(said) else "") + junk for k, w in enumerate(said)) + rng.choice(["."] * 5 + ["!", "?", "", ":", "." + junk])

    def prose(most=5):
        return " ".join(sentence(3, 18) for _ in range(rng.randint(1, most)))

    def put(inner, main):
        parts.append(inner)
        labels.append(main)

    def wrap(kind, fill):
        tag = rng.choice(LAYOUT[kind])
        while "{}" in tag:  # a name that tells nothing, or a wrong one
            tag = tag.replace("{}", rng.choice(LAYOUT["word"]) if kind == "misled" else "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 9))), 1)
        parts.append(f"<{tag}>" if tag else "")
        fill()
        parts.append("".join(f"</{t.split()[0]}>" for t in reversed(tag.split("><"))) if tag else "")

    def wrapped(most, fill, around=False):
        """Inside some elements that tell nothing; those around the whole text may even mislead."""
        if most and rng.random() < 0.5:
            wrap("misled" if around and rng.random() < 0.25 else "any", lambda: wrapped(most - 1, fill, around))
        else:
            fill()

    def links(n):
        parts.append("<ul>")
        for _ in range(n):
            put(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>', False)
        parts.append("</ul>")

    def boiler():
        tag = rng.choice(["p", "p", "p", "li", "h3", "h4", "div", "span"])
        put(f"<{tag}>{prose(3) if rng.random() < 0.6 else words(1, 6)}</{tag}>", False)
        if tag == "span":
            parts[-1] = f"<div>{parts[-1]}</div>"

    def fields():
        for _ in range(rng.randint(1, 3)):
            put(rng.choice([f"<label>{words(1, 3)}</label><input>", f"<p>{words(1, 5)}</p><input>", f"<button>{words(1, 2)}</button>", f"<select><option>{words(1, 2)}</select>", f"<textarea>{words(1, 4)}</textarea>", f"<legend>{words(1, 3)}</legend>"]), False)

    def table():
        parts.append("<table>")
        if rng.random() < 0.3:
            put(f"<caption>{words(2, 6)}</caption>", True)
        columns = rng.randint(2, 4)
        for row in range(rng.randint(2, 4)):
            parts.append("<tr>")
            for _ in range(columns):
                tag = "th" if row == 0 and rng.random() < 0.7 else "td"
                put(f"<{tag}>{rng.choice([words(1, 3), str(rng.randint(1, 9999)), sentence(2, 8)])}" + rng.choice(["", f"</{tag}>"]), True)
            parts.append(rng.choice(["", "</tr>"]))
        parts.append("</table>")

    def piece():
        x = rng.random()
        if x < 0.56:
            put(f"<{para}>{rng.choice(['', '', '<b>'])}{prose(7)}</{para}>" if rng.random() < 0.9 else f"<p><b>{sentence(2, 12)}<br>", True)
        elif x < 0.63:
            h = rng.choice("23456")
            put(f"<h{h}>{words(1, 6)}</h{h}>", True)
        elif x < 0.68:
            tag = rng.choice(["ul", "ol"])
            parts.append(f"<{tag}>")
            for _ in range(rng.randint(1, 4)):
                put(f"<li>{rng.choice([sentence(3, 14), words(1, 4)])}" + rng.choice(["", "</li>"]), True)
            parts.append(f"</{tag}>")
        elif x < 0.71:
            put(f"<blockquote>{rng.choice(['', '<p>'])}{prose(3)}</blockquote>", True)
        elif x < 0.74:
            put(f"<pre>{words(2, 20)}</pre>", True)
        elif x < 0.77:
            put(f"<p>{words(1, 3)}{rng.choice(['', '.', '.' + junk])}</p>", True)
        elif x < 0.80:
            put(f"<figure><img><figcaption>{rng.choice([sentence(3, 12), words(2, 8)])}</figcaption></figure>", True)
        elif x < 0.83:
            table()
        elif x < 0.85:
            parts.append("<dl>")
            for _ in range(rng.randint(1, 3)):
                put(f"<dt>{words(1, 3)}", True)
                put(f"<dd>{sentence(3, 12)}", True)
            parts.append("</dl>")
        elif x < 0.87:
            put(f"<div>{prose(3)}</div>", True)
        elif x < 0.92:
            wrap("advert", boiler)
        elif x < 0.95:
            wrap("form", fields)
        else:
            wrap(rng.choice(["notice", "side", "share"]), boiler)

    def body():
        if rng.random() < 0.85:
            head = f"<h1>{words(2, 9)}{rng.choice(['', '.', ''])}</h1>"
            put(f"<header>{head}</header>" if rng.random() < 0.08 and "".join(parts[-1:])[:8] in ("<article", "<main>") else head, True)
        if rng.random() < 0.15:
            wrap("share", lambda: links(2) if rng.random() < 0.5 else boiler())
        if rng.random() < 0.06:  # an article that is a list
            tag = rng.choice(["ul", "ol"])
            parts.append(f"<{tag}>")
            for _ in range(rng.randint(3, 9)):
                put(f"<li>{rng.choice(['', words(1, 3) + ': '])}" + rng.choice([f'<a href="/{words(1, 1)}">{words(1, 6)}</a>', f'{sentence(2, 9)} <a href="/x">{words(1, 4)}</a> {words(0, 3)}', sentence(3, 14)]) + rng.choice(["", "</li>"]), True)
            parts.append(f"</{tag}>")
        for _ in range(rng.randint(1, 7)):
            if rng.random() < 0.2:
                wrap("any", lambda: [piece() for _ in range(rng.randint(1, 4))])
            else:
                [piece() for _ in range(rng.randint(1, 2))]
        if rng.random() < 0.12:
            wrap("comments", lambda: [boiler() for _ in range(rng.randint(1, 3))])

    if rng.random() < 0.08:  # a piece of a page
        wrap("main", body)
        return "".join(parts), labels
    if rng.random() < 0.9:
        put(f"<html><head><title>{words(2, 8)}</title></head><body>", False)
    outer = rng.random() < 0.3
    parts.append("<div>" if outer else "")
    if rng.random() < 0.4:
        wrap("notice", boiler)
    if rng.random() < 0.6:
        wrap("top", lambda: (put(f"<h{(h := rng.choice('12'))}>{words(1, 4)}</h{h}>", False), rng.random() < 0.4 and links(3), rng.random() < 0.3 and boiler()))
    if rng.random() < 0.8:
        wrapped(1, lambda: wrap("menu", lambda: links(rng.randint(2, 8))))
    if rng.random() < 0.4:
        wrap("form", fields)
    if rng.random() < 0.5:
        wrap("advert", boiler)
    if rng.random() < 0.25:
        wrapped(1, lambda: wrap("side", lambda: [boiler() for _ in range(rng.randint(1, 3))]))
    if rng.random() < 0.97:
        wrapped(3, lambda: wrap("main", lambda: wrapped(2, body, True)), True)
    for kind, share in (("advert", 0.3), ("comments", 0.4), ("side", 0.4), ("notice", 0.2), ("form", 0.2)):
        if rng.random() < share:
            fill = fields if kind == "form" else lambda kind=kind: [boiler() for _ in range(rng.randint(1, 4))] if rng.random() < 0.7 or kind != "side" else links(4)
            wrapped(1, lambda kind=kind, fill=fill: wrap(kind, fill))
    parts.append("</div>" if outer else "")
    if rng.random() < 0.85:
        wrap("foot", lambda: (rng.random() < 0.4 and links(3), put(f"<p>{rng.choice(['&copy; ', '', '(c) '])}{words(1, 5)} {prose(2) if rng.random() < 0.5 else ''}</p>", False)))
    return "".join(parts), labels


class Crf:
    """Two states (1: main text); weights of features and of transitions, start and end."""

    def __init__(self, number: dict[str, int], emit: np.ndarray, step: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.number, self.emit, self.step, self.start, self.end = number, emit, step, start, end
        self.diff = {f: emit[i].tolist() for f, i in number.items()}

    def decode(self, found: list[list[str]]) -> list[bool]:
        """The best states of a chain, by Viterbi; a tie goes to boilerplate."""
        (s00, s01), (s10, s11) = self.step.tolist()
        back, a, b = [], 0.0, 0.0
        for k, f in enumerate(found):
            e0 = e1 = 0.0
            for x in f:
                if (w := self.diff.get(x)) is not None:
                    e0 += w[0]
                    e1 += w[1]
            if k == 0:
                a, b = self.start[0] + e0, self.start[1] + e1
            else:
                to0, to1 = (a + s00, b + s10), (a + s01, b + s11)
                back.append((to0[1] > to0[0], to1[1] > to1[0]))
                a, b = max(to0) + e0, max(to1) + e1
        if not found:
            return []
        state = b + self.end[1] > a + self.end[0]
        out = [state]
        for stay in reversed(back):
            state = stay[int(state)]
            out.append(state)
        return [bool(s) for s in reversed(out)]


@functools.cache
def train(pages: int = 600, seed: int = 7, steps: int = 100, rate: float = 0.1, decay: float = 2e-4) -> Crf:
    """A chain trained on generated pages by Adam on the conditional likelihood, all pages at once."""
    rng = random.Random(seed)
    chains, states = [], []
    while len(chains) < pages:
        page, labels = labelled_page(rng)
        found = blocks(page)
        if len(found) == len(labels) and found:
            chains.append(features(found))
            states.append(labels)
    number: dict[str, int] = {}
    for chain in chains:
        for f in chain:
            for x in f:
                number.setdefault(x, len(number))
    n, longest = len(chains), max(map(len, chains))
    here = np.array([[t < len(c) for c in chains] for t in range(longest)])
    flat = np.zeros((int(here.sum()), len(number)), np.float32)
    y = np.zeros((longest, n), int)
    for row, (t, i) in enumerate(np.argwhere(here).tolist()):
        flat[row, [number[v] for v in chains[i][t]]] = 1
        y[t, i] = int(states[i][t])
    last = here.sum(axis=0) - 1
    gold = np.stack([(y == s) & here for s in (0, 1)], axis=-1).astype(float)
    theta = np.zeros(2 * len(number) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = here[1:] & here[:-1]
    gold_step = np.einsum("tni,tnj->ij", gold[:-1] * both[..., None], gold[1:] * both[..., None])

    def log_sum(z, axis):
        top = z.max(axis=axis, keepdims=True)
        return (np.log(np.exp(z - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for k in range(1, steps + 1):
        emit, step = theta[: 2 * len(number)].reshape(-1, 2), theta[-8:-4].reshape(2, 2)
        start, end = theta[-4:-2], theta[-2:]
        e = np.zeros((longest, n, 2))
        e[here] = flat @ emit.astype(np.float32)
        fore, rear = np.zeros_like(e), np.zeros_like(e)
        fore[0] = start + e[0]
        for t in range(1, longest):
            fore[t] = np.where(here[t][:, None], log_sum(fore[t - 1][:, :, None] + step[None], 1) + e[t], fore[t - 1])
        for t in range(longest - 1, -1, -1):
            rear[t] = end if t == longest - 1 else np.where((t == last)[:, None], end, log_sum(step[None] + (e[t + 1] + rear[t + 1])[:, None, :], 2))
        z = log_sum(fore[-1] + end, 1)
        p = np.exp(fore + rear - z[None, :, None]) * here[..., None]
        pair = np.exp(fore[:-1][..., :, None] + step + (e[1:] + rear[1:])[..., None, :] - z[None, :, None, None]) * both[..., None, None]
        miss = (p - gold)[here].astype(np.float32)
        at_last = lambda q: q[last, np.arange(n)].sum(axis=0)
        g = np.concatenate([(flat.T @ miss).ravel(), (pair.sum(axis=(0, 1)) - gold_step).ravel(), (p[0] - gold[0]).sum(axis=0), at_last(p) - at_last(gold)]) / n + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    emit, step = theta[: 2 * len(number)].reshape(-1, 2), theta[-8:-4].reshape(2, 2)
    return Crf(number, emit, step, theta[-4:-2], theta[-2:])


def main_text(page: str | None, crf: Crf) -> str:
    """The blocks that the chain takes as main text, joined by blank lines; empty for null and empty pages."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, crf.decode(features(found))) if keep)


def extract(pages: DataFrame, crf: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each row's whole page; ``n_chars`` counts code points.

    Null, empty and text-free pages give an empty text; pages of any length and depth are read whole. Where both states
    of a block are as good, it is boilerplate. Repeated rows stay repeated; extra columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    sent = pages.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2):
            texts = [main_text(p, sent.value) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return small_batches(rows).mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
