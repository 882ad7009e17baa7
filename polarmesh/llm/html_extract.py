"""Operator 6: main text of pages by wrappers, inferred as union-free regular expressions.

1. A page's tokens become a nested expression: elements, text slots, and runs
   of equal elements folded into repeated groups.
2. Within a task, each page is aligned with its host's wrapper so far. A
   mismatch of texts makes a text slot, one of elements an optional group, and
   equal neighbours a repeated group; no alternatives (unions) arise. So a
   wrapper is as large as the structure of its host's pages, not as their
   number; a task emits one for each of its hosts, and wrappers of a host are
   aligned with each other in two rounds, first by groups of tasks. A host
   with a third of all pages is thus never gathered.
3. The wrapper tells which of its slots hold the article: where the text is
   that varies from page to page and is no link. An element that a host marks
   as article is one only if it holds a part of that text; where none is
   marked, layout elements with little of it stand beside the article. Pages
   are parsed along their wrapper, and the text in article slots is kept
   whole.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.shared import materialise, small_batches
from polarmesh.llm.url_filter import url_parts

# Classes of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = set("nav footer aside form script style noscript template head title iframe button select textarea menu dialog svg".split())
BODY_NAMES = set("article article-body articlebody content post post-content entry entry-content main main-content story story-body text".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of a class or id that mark what is no article.
BOILERPLATE_NAMES = set("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side-bar widget footer header masthead cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments reply replies respond disqus discussion login signup search pagination pager toolbar copyright legal disclaimer".split())

BOILERPLATE_ROLES = {"role=navigation", "role=banner", "role=contentinfo", "role=complementary", "role=search"}
#: Tags that divide a page's layout.
CONTAINERS = set("html body div section main article center form table tbody tr td".split())
#: Pages a host must have before its wrapper tells constant text from text that varies.
LEAST_PAGES = 3
#: A container with a smaller share of the largest one's varying text stands beside the article.
ASIDE = 0.1
#: Pages of a host that one task reads when wrappers are joined, and JSON of wrappers that it holds.
PAGES_DEALT, HELD_BYTES = 10_000, 16_000_000
#: First parts of the names of articles that belong to another article.
COMMENTS = set("comment comments reply replies related recommended sponsored advertisement".split())
#: First parts of the names of boxes for readers' comments, their forms, and adverts (comment-form, ad-box).
BOXES = set("comment comments disqus respond ad ads advert adverts advertisement advertising sponsored".split())
#: First parts of the names of boxes for readers' comments, their forms, and adverts (comment-form, ad-box).
BOXES = set("comment comments disqus respond ad ads advert adverts advertisement advertising sponsored".split())
#: Parts of a class before a name that make it a state of the layout or a topic.
STATES = set("has have no not with without is layout template category cat tag topic subject keyword section".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)


class Node:
    """An element: its label (tag, then the words of class and id), children, and text pieces among them as strings."""

    __slots__ = ("tag", "label", "kids")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.kids = tag, label, []


def _label(tag: str, attributes: str) -> str:
    words: list[str] = []
    for name, a, b, c in _NAME.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words += [w for w in value.split() if not any(ch.isdigit() for ch in w)]
        elif name == "role":
            words.append("role=" + value)
        elif name == "hidden" or value == "true":
            words.append("hidden")
    return ".".join([tag, *sorted(set(words))])


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are borne as browsers do, roughly."""
    root = Node("", "")
    stack = [root]
    held: Counter[str] = Counter()  # open elements by tag, so that no end without one searches the stack
    at, n = 0, len(page)

    def close(k: int) -> None:
        held.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray inline end doesn't close blocks
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if held["p"] else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th"):
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}[tag]
            for k in range(len(stack) - 1, 0, -1) if any(held[x] for x in ends) else ():
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "div", "section"):
                    break
        node = Node(tag, _label(tag, m[3] or ""))
        stack[-1].kids.append(node)
        if tag in VOID:  # a slash before the end closes no other element of HTML
            continue
        if tag in OPAQUE:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
        held[tag] += 1
    return root


def run(call: Generator) -> Any:
    """The result of a recursive function written as a generator that yields its inner calls: pages nest deeper than Python's stack."""
    calls, value = [call], None
    while calls:
        try:
            calls.append(calls[-1].send(value))
            value = None
        except StopIteration as end:
            calls.pop()
            value = end.value
    return value


# A wrapper node is a list: label, flags (1 optional, 2 repeated), pages, text characters, link characters, text hash (None once it varies), children.
LABEL, FLAGS, PAGES, CHARS, LINKS, HASH, KIDS = range(7)


def expression(node: Node) -> list:
    """The wrapper of one page alone, equal neighbours folded."""
    return run(_expression(node, False))


def _expression(node: Node, in_link: bool) -> Generator:
    own = [k for k in node.kids if isinstance(k, str)] if node.tag not in OPAQUE else []
    text = " ".join(" ".join(own).split())
    link = in_link or node.tag == "a"
    kids = []
    if node.tag not in BOILERPLATE or node.tag == "body":
        for k in node.kids:
            if not isinstance(k, str):
                kids.append((yield _expression(k, link)))
    chars = len(text)
    return [node.label, 0, 1, chars, chars * link, hash_text(text), (yield _fold(kids)) if len(kids) > 1 else kids]


def hash_text(text: str) -> int | None:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass")) if text else 0


def _fold(kids: list) -> Generator:
    """Equal neighbours become one repeated element; then runs of two or more elements that recur side by side do."""
    out: list = []
    for kid in kids:
        if out and out[-1][LABEL] == kid[LABEL]:
            out[-1] = yield _align(out[-1], kid, True, True)
        else:
            out.append(kid)
    size = 2
    while 2 * size <= len(out) and size <= 6:
        k = 0
        while k + 2 * size <= len(out):
            if all(out[k + j][LABEL] == out[k + size + j][LABEL] for j in range(size)):
                for j in range(size):
                    out[k + j] = yield _align(out[k + j], out[k + size + j], True, True)
                del out[k + size : k + 2 * size]
            else:
                k += 1
        size += 1
    return out


def align(a: list, b: list, repeat: bool = False) -> list:
    """One expression for both, which have the same label; `repeat` if they stand in one page."""
    return run(_align(a, b, repeat))


def _align(a: list, b: list, repeat: bool = False, own: bool = False) -> Generator:
    """`own` if both are of one page alone: their texts then follow each other, and don't vary for it."""
    text = a[HASH] if a[HASH] == b[HASH] else None if not own or None in (a[HASH], b[HASH]) else hash_text(f"{a[HASH]} {b[HASH]}")
    pages = max(a[PAGES], b[PAGES]) if repeat else a[PAGES] + b[PAGES]
    kids = (yield _align_lists(a[KIDS], b[KIDS], own)) if a[KIDS] or b[KIDS] else []
    return [a[LABEL], a[FLAGS] | b[FLAGS] | 2 * repeat, pages, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], text, kids]


def _align_lists(a: list, b: list, own: bool) -> Generator:
    """Longest common subsequence of labels; what has no partner becomes optional. Labels that come out twice are folded."""
    la, lb = [x[LABEL] for x in a], [x[LABEL] for x in b]
    out: list = []
    if la == lb:
        for x, y in zip(a, b, strict=True):
            out.append((yield _align(x, y, False, own)))
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if la[i] == lb[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if la[i] == lb[j]:
            out.append((yield _align(a[i], b[j], False, own)))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][LABEL], a[i][FLAGS] | 1, *a[i][PAGES:]])
            i += 1
        else:
            out.append([b[j][LABEL], b[j][FLAGS] | 1, *b[j][PAGES:]])
            j += 1
    out += [[x[LABEL], x[FLAGS] | 1, *x[PAGES:]] for x in [*a[i:], *b[j:]]]
    # the same label at several places: one optional, repeated element keeps the expression as small as the structure
    merged: list = []
    where: dict[str, int] = {}
    for x in out:
        if x[LABEL] in where:
            k = where[x[LABEL]]
            merged[k] = yield _align(merged[k], x, True, own)
            merged[k][FLAGS] |= 1
        else:
            where[x[LABEL]] = len(merged)
            merged.append(x)
    return merged


def regular_expression(w: list) -> str:
    """The wrapper as text: elements, #TEXT for slots that vary, ( )? and ( )+ groups."""
    return run(_regular_expression(w))


def _regular_expression(w: list) -> Generator:
    inner = []
    for k in w[KIDS]:
        inner.append((yield _regular_expression(k)))
    slot = "#TEXT" if w[HASH] is None else "text" if w[CHARS] else ""
    body = f"<{w[LABEL]}>" + slot + "".join(inner) + "</>"
    return f"({body})" + {0: "", 1: "?", 2: "+", 3: "*"}[w[FLAGS]] if w[FLAGS] else body


def below(w: list) -> Iterator[list]:
    """A wrapper's element and all below it, parents first, in the order of the page."""
    todo = [w]
    while todo:
        w = todo.pop()
        yield w
        todo += reversed(w[KIDS])


def pack(w: list) -> str:
    """A wrapper as JSON, flat: JSON's reader and writer don't nest as deep as pages do."""
    return json.dumps([[*x[:KIDS], len(x[KIDS])] for x in below(w)])


def unpack(text: str) -> list:
    rows = json.loads(text)
    counts = [x[KIDS] for x in rows]
    last: list[list] = []
    for row, n in zip(reversed(rows), reversed(counts), strict=True):
        row[KIDS] = [last.pop() for _ in range(n)]
        last.append(row)
    return last[0]


def _names(label: str) -> tuple[str, list[str]]:
    tag, *words = label.split(".")
    return tag, words


@lru_cache(100_000)
def is_boilerplate(label: str, named: bool = True) -> bool:
    """Whether an element's tag, role or, if `named`, a whole class or id marks it as no article; <html>, <body>, <main> and <article> are never judged by names."""
    tag, words = _names(label)
    if tag in ("html", "body"):
        return False
    if tag in BOILERPLATE or "hidden" in words or BOILERPLATE_ROLES & set(words):
        return True
    return named and tag not in ("main", "article") and bool(BOILERPLATE_NAMES & set(words))


@lru_cache(100_000)
def ends_as_boilerplate(label: str) -> bool:
    """Whether a container's class or id ends in such a name (left-sidebar), and doesn't say that there is one (has-sidebar) or what a text is about (category-social).

    Names that begin as those of comments and adverts do (comments-list, ad-box) mark their boxes too.
    """
    tag, words = _names(label)
    parts = [re.split(r"[-_]", w) for w in words] if tag in ("div", "ul", "ol") else []
    boxes = [re.split(r"[-_]", w) for w in words] if tag in ("div", "ul", "ol", "section", "p") else []
    return any(len(p) > 1 and p[-1] in BOILERPLATE_NAMES and p[-2] not in STATES and p[0] not in STATES for p in parts) or any(len(p) > 1 and p[0] in BOXES for p in boxes)


def is_comment(label: str) -> bool:
    """Whether an <article> inside or beside another is a comment or a teaser."""
    tag, words = _names(label)
    return tag == "article" and any(re.split(r"[-_]", w)[0] in COMMENTS for w in words)


def _mark(label: str) -> int | None:
    """Rank of an element as the article's mark: <article>, <main>, a main role, a class or id that names a body; else None."""
    tag, words = _names(label)
    return 0 if tag == "article" else 1 if tag == "main" else 2 if "role=main" in words else 3 if BODY_NAMES & set(words) else None


def article_of(w: list, named: bool = True) -> int | None:
    """How the host marks its articles: the best rank among the wrapper's elements, or None."""
    ranks, todo = [], [w]
    while todo:
        w = todo.pop()
        if not is_boilerplate(w[LABEL], named):
            ranks.append(_mark(w[LABEL]))
            todo += w[KIDS]
    return min((r for r in ranks if r is not None), default=None)


def holds_mark(node: Node) -> bool:
    """Whether an element below this one is marked as an article."""
    todo = [node]
    while todo:
        for kid in todo.pop().kids:
            if not isinstance(kid, str):
                if _mark(kid.label) is not None:
                    return True
                todo.append(kid)
    return False


def masses(w: list, varying: bool = True) -> dict[int, int]:
    """For each element of a wrapper, by its identity: characters in and below it that are no links, no boilerplate, and, if `varying`, not the same on all pages."""
    open_, todo = [], [w]
    while todo:
        x = todo.pop()
        open_.append(x)
        todo += [k for k in x[KIDS] if not is_boilerplate(k[LABEL])]
    out: dict[int, int] = {}
    for x in reversed(open_):
        own = x[CHARS] - x[LINKS] if x[HASH] is None or not varying else 0
        out[id(x)] = own + sum(out.get(id(k), 0) for k in x[KIDS])
    return out


def beside(w: list, mass: dict[int, int]) -> set[int]:
    """Elements of a wrapper (by identity) that stand beside the article.

    Where an element's text is mostly in containers, those go that have less
    than `ASIDE` of the largest one's; the others are looked into. Where it
    is mostly outside containers, the article is reached and kept whole.
    """
    out: set[int] = set()
    todo = [w]
    while todo:
        x = todo.pop()
        parts = [k for k in x[KIDS] if _names(k[LABEL])[0] in CONTAINERS]
        largest = max((mass.get(id(k), 0) for k in parts), default=0)
        flow = mass[id(x)] - sum(mass.get(id(k), 0) for k in parts)
        if 2 * flow >= largest:
            continue
        kept = [k for k in parts if mass.get(id(k), 0) >= ASIDE * largest]
        out |= {id(k) for k in parts} - {id(k) for k in kept}
        todo += kept
    return out


class Judged:
    """A host's wrapper with what it tells of the host's pages.

    `mark` and `mark_inside`: how articles are marked, outside boilerplate
    names and also inside; None if they aren't, or if elements so marked hold
    less than `ASIDE` of the text that varies (teasers beside the article).
    `beside`: elements beside the article. These need `LEAST_PAGES` pages:
    with fewer, what varies isn't known.
    """

    def __init__(self, wrapper: list | None):
        self.wrapper, self.beside = wrapper, set()
        self.mark = article_of(wrapper) if wrapper else None
        self.mark_inside = article_of(wrapper, False) if wrapper else None
        self.varies = wrapper is not None and _varies(wrapper)
        if wrapper is None or wrapper[PAGES] < LEAST_PAGES or not self.varies:
            return
        mass = masses(wrapper)
        if self.mark is not None:
            every = masses(wrapper, False)
            marked = _marked(wrapper, self.mark)
            if all(sum(m[id(x)] for x in marked) < ASIDE * m[id(wrapper)] for m in (mass, every)):
                self.mark = self.mark_inside = None
        if self.mark is None:
            self.beside = beside(wrapper, mass)


def _marked(w: list, mark: int) -> list[list]:
    """The outermost elements of a wrapper with this mark, outside boilerplate."""
    out, todo = [], [w]
    while todo:
        x = todo.pop()
        if _mark(x[LABEL]) == mark:
            out.append(x)
        else:
            todo += [k for k in x[KIDS] if not is_boilerplate(k[LABEL])]
    return out


def extract(page: str, wrapper: list | Judged | None) -> str:
    """The main text of a page, read along its host's wrapper.

    If the host marks its articles, the text in that element is kept, but for
    boilerplate inside it; in pages without the mark, and on hosts that mark
    none or only teasers, all but boilerplate, elements that the wrapper finds
    beside the article, repeated link lists, and text that is the same on all
    of at least three of the host's pages that differ elsewhere. On the way to
    an article only whole names are judged. A page without one outside such
    names is also read from those inside, and the longer text is kept. What
    would leave a page no text by the wrapper's or the end of a name's
    judgement isn't judged by it.
    """
    host = wrapper if isinstance(wrapper, Judged) else Judged(wrapper)
    tree = parse(page)
    roots = _roots(tree, host.wrapper, host.mark, True)
    starts = roots or [(tree, host.wrapper)]
    text = _read(starts, host, not roots)
    if not roots and host.mark_inside is not None:
        text = max(text, _read(_roots(tree, host.wrapper, host.mark_inside, False), host, False), key=len)
    return text or _read(starts, host, not roots, False)


def _roots(tree: Node, wrapper: list | None, mark: int | None, named: bool) -> list[tuple[Node, list | None]]:
    """The outermost elements with this mark outside boilerplate, and their places in the wrapper."""
    roots: list[tuple[Node, list | None]] = []
    todo: list[tuple[Node, list | None]] = [(tree, wrapper)] if mark is not None else []
    while todo:
        node, w = todo.pop()
        if node is not tree and _mark(node.label) == mark:
            roots.append((node, w))
            continue
        inside = {k[LABEL]: k for k in w[KIDS]} if w else {}
        todo += [(kid, inside.get(kid.label)) for kid in reversed(node.kids) if not isinstance(kid, str) and not is_boilerplate(kid.label, named)]
    return [r for r in roots if not is_comment(r[0].label)] or roots


def _read(roots: list[tuple[Node, list | None]], host: Judged, whole: bool, ends: bool = True) -> str:
    """The text below the roots; `whole` if they are no marked articles, `ends` if places beside the article and the ends of names are judged."""
    blocks: list[list[str]] = [[]]

    def emit(node: Node, w: list | None, plain: bool) -> Generator:
        inside = {k[LABEL]: k for k in w[KIDS]} if w else {}
        constant = plain and w is not None and w[HASH] is not None and w[CHARS] and w[PAGES] >= LEAST_PAGES and host.wrapper[PAGES] == w[PAGES] and host.varies
        for kid in node.kids:
            if isinstance(kid, str):
                if not constant:
                    blocks[-1].append(html.unescape(kid))
                continue
            if kid.tag == "br":
                blocks[-1].append(" ")
                continue
            own = inside.get(kid.label)
            if is_boilerplate(kid.label) or kid.tag in OPAQUE or plain and kid.tag == "header" or not plain and is_comment(kid.label):
                skip = True
            elif ends and plain and id(own) in host.beside:
                skip = True
            elif ends and ends_as_boilerplate(kid.label) and not holds_mark(kid):
                skip = True
            else:
                skip = plain and own is not None and own[FLAGS] & 2 and kid.tag in ("ul", "ol", "li") and 2 * _links(own) > _chars(own)
            block = kid.tag not in INLINE
            if block:
                blocks.append([])
            if not skip:
                yield emit(kid, own, plain)
            if block:
                blocks.append([])

    for node, w in roots:
        blocks.append([])
        run(emit(node, w, whole))
    texts = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def _chars(w: list) -> int:
    return sum(x[CHARS] for x in below(w))


def _links(w: list) -> int:
    return sum(x[LINKS] for x in below(w))


def _varies(w: list) -> bool:
    return any(x[HASH] is None for x in below(w))


def wrappers(pages: DataFrame, hosts_held: int = 500) -> DataFrame:
    """One row for each host of `pages` (host, html): host, wrapper (as JSON).

    A task holds at most `hosts_held` wrappers, then emits them and begins
    anew; rows of a host are merged by groups of tasks, then all.
    """

    def infer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, made = TaskContext.get().partitionId(), {}, 0
        for frame in frames:
            for host, page in zip(frame["host"], frame["html"], strict=True):
                own = expression(parse(page))
                held[host] = align(held[host], own) if host in held else own
                if len(held) >= hosts_held:
                    yield pd.DataFrame({"host": list(held), "part": task * 31 + made, "wrapper": [pack(w) for w in held.values()]})
                    held, made = {}, made + 1
        if held:
            yield pd.DataFrame({"host": list(held), "part": task * 31 + made, "wrapper": [pack(w) for w in held.values()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(frame["wrapper"])
        out = unpack(rows[0])
        for row in rows[1:]:
            out = align(out, unpack(row))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [pack(out)]})

    made = pages.mapInPandas(infer, "host string, part long, wrapper string").withColumn("part", F.floor(F.sqrt("part")).cast("long"))
    return made.groupBy("host", "part").applyInPandas(merge, "host string, wrapper string").groupBy("host").applyInPandas(merge, "host string, wrapper string")


def _judging() -> Callable[[str, str], Judged]:
    """Gives the judged wrapper of a host; a task holds those of `HELD_BYTES` of JSON, then begins anew."""
    known: dict[str, Judged] = {}
    size = 0

    def judged(host: str, wrapper: str) -> Judged:
        nonlocal size
        if host not in known:
            if size > HELD_BYTES:
                known.clear()
                size = 0
            size += len(wrapper)
            known[host] = Judged(unpack(wrapper))
        return known[host]

    return judged


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 64_000_000, pages_dealt: int = PAGES_DEALT) -> DataFrame:
    """One row for each row of `pages`: page_id, url, text, n_chars.

    Null or empty html gives an empty text. Pages without a host (null or odd
    urls) share the wrapper of the empty host. Null ids stay, repeated rows
    give a row each, other columns are dropped, an empty table gives an empty
    result; pages are read whole, however long and however deep they nest. Wrappers are broadcast only
    if all together have at most `broadcast_bytes`; else they are joined by
    host, and a host with many pages is dealt to a task for every
    `pages_dealt` of them.
    """
    small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), url_parts(F.col(url_col).cast("string"))[0].alias("host"))
    found = materialise(wrappers(source.select("host", "html")), "wrappers")
    size = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    kind = source.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    if size <= broadcast_bytes:
        shared = source.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.collect()})

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            judged = _judging()
            for frame in frames:
                yield frame[["page_id", "url"]].assign(text=[extract(page, judged(host, shared.value[host])) for host, page in zip(frame["host"], frame["html"], strict=True)])

        out = source.mapInPandas(read, schema)
    else:

        def read_joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            judged = _judging()
            for frame in frames:
                yield frame[["page_id", "url"]].assign(text=[extract(page, judged(host, w)) for host, page, w in zip(frame["host"], frame["html"], frame["wrapper"], strict=True)])

        counts = source.groupBy("host").agg(F.count("*").alias("n"))
        total = source.count()
        # fewer than 1,000 hosts, as each has more than that part of all pages
        hot = F.broadcast(counts.where(F.col("n") > max(pages_dealt, total // 1000)).select("host", F.ceil(F.col("n") / pages_dealt).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        dealt = source.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), salts).cast("int"))
        copies = found.join(hot, "host", "left").select("host", "wrapper", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        out = dealt.join(copies, ["host", "salt"]).mapInPandas(read_joined, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
