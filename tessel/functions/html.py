"""Elements of HTML pages: a tokenizer, a stack of open elements and compound selectors, in Arrow batches.

Pages are read once, as a browser's tokenizer does: every character is looked at a bounded number of times, broken tags
and open quotes too. All selectors are matched while elements open, so that no tree is built.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow import released, small_batches

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)?))?""")
#: Elements without an end, with text instead of elements, and those whose text is none of the page's.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
SILENT = frozenset("script style".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Open elements that an element ends, as far as the elements at which that stops.
BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd"
IMPLIED = {tag: (frozenset(ended.split()), frozenset(until.split())) for tags, ended, until in (
    (BLOCKS, "p", "table td th caption button object template"),
    ("option optgroup", "option", "select datalist"),
    ("tr", "tr td th", "table tbody thead tfoot template"), ("td th", "td th", "tr table template"),
    ("tbody thead tfoot", "tbody thead tfoot tr td th caption", "table template"),
) for tag in tags.split()}
LISTED = {"li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]))}


def tokens(page: str) -> Iterator[tuple[str, str, dict | None]]:
    """("text", text, None), ("open", tag, attributes) and ("close", tag, None) of a page, in order; comments and declarations are left out, attributes not decoded."""
    at, n, said = 0, len(page), 0
    while (at := page.find("<", at)) >= 0:
        name = NAME.match(page, at + 1)
        if name is None:
            if not page.startswith(("</", "<!", "<?"), at) or at + 2 >= n:
                at += 1
                continue
            if said < at:
                yield "text", page[said:at], None
            if page.startswith("<!--", at):
                end = at + 4 if page.startswith((">", "->"), at + 4) else page.find("-->", at + 4)
                at = said = n if end < 0 else page.find(">", end) + 1
                continue
            end = page.find(">", at)
            if page[at + 1] == "/" and (name := NAME.match(page, at + 2)) and end >= 0:
                yield "close", name.group().lower(), None
            at = said = n if end < 0 else end + 1
            continue
        if said < at:
            yield "text", page[said:at], None
        tag, at, attributes = name.group().lower(), name.end(), {}
        while (found := ATTRIBUTE.match(page, at)) is not None:
            attributes.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
            at = found.end()
        end = page.find(">", at)
        if end < 0:  # the page ends inside the tag, which is dropped
            said = n
            break
        at = said = end + 1
        yield "open", tag, attributes
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            end = close.start() if close else n
            if at < end:
                yield "text", page[at:end], None
            yield "close", tag, None
            at = said = n if close is None else (page.find(">", end) + 1 or n)
    if said < n:
        yield "text", page[said:], None


COMPOUND = re.compile(r"""([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)""")
PART = re.compile(r"""([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*["']?([^\]"']*)["']?\s*)?\]""")
TESTS = {"": lambda have, want: True, "=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith, "~=": lambda have, want: want in have.split()}


class Rules:
    """Selectors by name: lists of compounds (tag, classes, id, attributes) joined as descendants or children.

    Each step of each selector is a bit; an element's bits are the steps that end at it.
    """

    def __init__(self, selectors: dict[str, str]):
        self.by_key, self.final, self.named, bit = defaultdict(list), defaultdict(list), {0: []}, 1
        for name, selector in selectors.items():
            for one in re.findall(r"(?:\[[^\]]*\]|[^,\[])+", selector):
                before, child = 0, False
                for word in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one):
                    if word == ">":
                        child = True
                        continue
                    m = COMPOUND.fullmatch(word)
                    if m is None:
                        raise ValueError(f"no selector: {one}")
                    classes, ids, tests = set(), "", []
                    for sign, what, attribute, test, value in PART.findall(m[2]):
                        if sign == ".":
                            classes.add(what)
                        elif sign:
                            ids = what
                        else:
                            tests.append((attribute.lower(), TESTS[test], value))
                    tag = "" if m[1] in (None, "*") else m[1].lower()
                    key = "." + min(classes) if classes else "#" + ids if ids else tag
                    self.by_key[key].append((bit, before, child, tag, frozenset(classes), ids, tests))
                    before, child, bit = bit, False, bit << 1
                self.final[before].append(name)

    def bits(self, tag: str, attributes: dict, above: int, parent: int) -> int:
        classes, keys, own = (), ["", tag], 0
        if attributes:
            classes = attributes.get("class", "").split()
            keys += ["#" + attributes["id"]] if "id" in attributes else []
            keys += ["." + c for c in classes]
        for key in keys:
            for bit, before, child, name, needed, ids, tests in self.by_key.get(key, ()):
                if (not before or before & (parent if child else above)) and name in ("", tag) and needed.issubset(classes) and (not ids or attributes.get("id") == ids):
                    if all(a in attributes and test(html.unescape(attributes[a]), value) for a, test, value in tests):
                        own |= bit
        return own

    def names(self, own: int) -> list[str]:
        if own not in self.named:
            self.named[own] = [name for bit, names in self.final.items() if own & bit for name in names]
        return self.named[own]


def matched(page: str, rules: Rules, root: str | None, spaced: frozenset = frozenset(), written: frozenset = frozenset()) -> list[tuple[dict, list[dict]]]:
    """(root, elements inside that match, in order) of each element that matches ``root``, or of the page as a whole.

    Elements of the rules in ``spaced`` ("" is the whole page) have all their text, of scripts too, with a space for each tag;
    those of the rules in ``written`` have their character references as the page has them.
    """
    whole = {"rule": "", "tag": "", "text": "", "attrs": []}
    found: list[tuple[dict, list[dict]]] = [(whole, [])] if root is None else []
    # an open element: tag, its bits, those of all above it, where its text begins, its matches, the roots it opened
    stack: list[tuple] = [("", 0, 0, 0, [whole] if root is None else [], 0)]
    roots, said, shown, raw, depths = [found[0][1]] if root is None else [], [], [], [], defaultdict(list)

    def close() -> None:
        tag, _, _, start, mine, opened = stack.pop()
        if mine:
            text = None
            for element in mine:
                if element["rule"] in spaced:
                    element["text"] = " ".join(said[start:])
                elif element["rule"] in written:
                    element["text"] = "".join(raw[start:])
                else:
                    text = element["text"] = "".join(shown[start:]) if text is None else text
        if opened:
            del roots[-opened:]
        if tag:
            depths[tag].pop()

    def last(tags: frozenset) -> int:
        at = 0
        for t in tags:
            if t in depths and (mine := depths[t]) and mine[-1] > at:
                at = mine[-1]
        return at

    def end(ended: frozenset, until: frozenset) -> None:
        while at := last(ended):
            if at <= last(until):
                break
            while len(stack) > at:
                close()

    for kind, what, attributes in tokens(page):
        if kind == "text":
            text = html.unescape(what) if "&" in what else what
            said.append(text)
            shown.append("" if stack[-1][0] in SILENT else text)
            if written:
                raw.append("" if stack[-1][0] in SILENT else what)
        elif kind == "close":
            if depths[what]:
                at = depths[what][-1]
                while len(stack) > at:
                    close()
        else:
            for table in (IMPLIED, LISTED):
                if what in table:
                    end(*table[what])
            _, parent, above, _, _, _ = stack[-1]
            own = rules.bits(what, attributes, above | parent, parent)
            mine, opened = [], 0
            if own and (names := rules.names(own)):
                attrs = [(k, html.unescape(v)) for k, v in attributes.items()]
                for name in names:
                    element = {"rule": name, "tag": what, "text": "", "attrs": attrs}
                    mine.append(element)
                    if name == root:
                        found.append((element, []))
                    else:
                        for inside in roots:
                            inside.append(element)
            if root is not None and any(e["rule"] == root for e in mine):
                roots.append(found[-1][1])
                opened = 1
            if what not in VOID:
                depths[what].append(len(stack))
                stack.append((what, own, above | parent, len(said), mine, opened))
            elif opened:
                roots.pop()
    while stack:
        close()
    return found


ELEMENT = "struct<rule:string,tag:string,text:string,attrs:map<string,string>>"
_ELEMENT = pa.struct([("rule", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])


def select(pages: DataFrame, html_col: str, selectors: dict[str, str], root: str | None = None, spaced: tuple[str, ...] = (), written: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` without ``html_col``, a row for each element that matches the selector named ``root`` (or for each page), with
    ``at`` (its number in the page), ``root`` (the element) and ``inside`` (the elements in it that match the others, in page order).

    An element has ``rule``, ``tag``, ``text`` and ``attrs``; one that matches several rules is there once for each. What
    lies in nested roots is inside all of them. Ends that HTML lets out are implied, scripts and styles have no text,
    character references are decoded (those cut short too, as browsers do), but for elements of the rules in ``written``.
    Elements of the rules in ``spaced`` ("": the whole page) have a space for each tag, and the text of scripts too. Null and
    empty pages have no elements.
    """
    rest = [c for c in pages.columns if c != html_col]
    fields = [*pages.select(*rest).schema.fields, *StructType.fromDDL(f"at int, root {ELEMENT}, inside array<{ELEMENT}>").fields]
    if len({f.name for f in fields}) < len(fields):
        raise ValueError("columns named at, root or inside, or repeated ones")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from elements(batches, Rules(selectors), root, frozenset(spaced), frozenset(written), [f.name for f in fields])

    small_batches(pages.sparkSession)
    return pages.select(html_col, *rest).mapInArrow(run, StructType(fields))


#: Characters of pages whose elements are given on together, but for a page that is longer.
TOGETHER = 1 << 19


def elements(batches: Iterator[pa.RecordBatch], rules: Rules, root: str | None, spaced: frozenset, written: frozenset, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``select`` of batches whose first column is the page, in batches of few pages."""
    rows, at, roots, inside, size = [], [], [], [], 0

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal size
        columns = [pa.array(at, pa.int32()), pa.array(roots, _ELEMENT), pa.array(inside, pa.list_(_ELEMENT))]
        out = pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[1:]), *columns], names=names)
        size = 0
        for some in (rows, at, roots, inside):
            some.clear()
        return out

    for batch in batches:
        for i, page in enumerate(batch.column(0)):
            text = page.as_py() or ""
            size += len(text)
            for k, (element, others) in enumerate(matched(text.replace("\r\n", "\n").replace("\r", "\n"), rules, root, spaced, written)):
                rows.append(i)
                at.append(k)
                roots.append(element)
                inside.append(others)
            if size > TOGETHER:
                yield made(batch)
        yield made(batch)
    released()


def read(pages: DataFrame, html_col: str, selectors: dict[str, str], told: Callable[[dict, list[dict]], tuple | None], made: str, spaced: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` without ``html_col``, with the columns ``made`` (DDL) that ``told`` gives of each page's ``root`` and ``inside`` (as ``select`` has them);
    a page of which it tells nothing goes. Elements and texts stay in Python: only what is made of them goes on.
    """
    rest = pages.columns
    rest.remove(html_col)
    schema = StructType.fromDDL(made)
    names, kinds = [*rest, *schema.names], [f.type for f in to_arrow_schema(schema)]
    if len(set(names)) < len(names):
        raise ValueError("repeated columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from told_of(batches, Rules(selectors), told, frozenset(spaced), names, kinds)

    small_batches(pages.sparkSession)
    return pages.select(html_col, *rest).mapInArrow(run, StructType([*pages.select(*rest).schema.fields, *schema.fields]))


def told_of(batches: Iterator[pa.RecordBatch], rules: Rules, told: Callable[[dict, list[dict]], tuple | None], spaced: frozenset, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows of ``read`` of batches whose first column is the page, in batches of few pages."""
    for batch in batches:
        rows, made, size = [], [], 0
        for i, page in enumerate(batch.column(0)):
            text = page.as_py() or ""
            size += len(text)
            [(root, inside)] = matched(text.replace("\r\n", "\n").replace("\r", "\n"), rules, None, spaced)
            if (of_page := told(root, inside)) is not None:
                rows.append(i)
                made.append(of_page)
            if made and (size > TOGETHER or i + 1 == batch.num_rows):
                columns = [pa.array(column, kind) for column, kind in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[1:]), *columns], names=names)
                rows, made, size = [], [], 0
    released()


def of(rule: str, inside: str | Column = "inside") -> Column:
    """The elements of one rule."""
    return F.filter(inside, lambda e: e["rule"] == rule)


def text_of(rule: str, inside: str | Column = "inside") -> Column:
    """The trimmed text of the first element of a rule; empty if there is none."""
    from .text import trimmed

    return F.coalesce(trimmed(F.get(of(rule, inside), F.lit(0))["text"]), F.lit(""))


def attr_of(rule: str, name: str, inside: str | Column = "inside") -> Column:
    """An attribute of the first element of a rule; empty if there is none."""
    return F.coalesce(F.try_element_at(F.get(of(rule, inside), F.lit(0))["attrs"], F.lit(name)), F.lit(""))
