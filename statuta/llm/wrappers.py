"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page's tokens (block elements, and text slots between their tags; inline markup belongs to its slot) are nested by their elements. Within an element, equal neighbours and
equal runs of neighbours become repeated groups. Pages of one host are then aligned, element by element: what only one side has becomes
optional, what repeats on either side repeats, and slots that meet become one slot that knows whether its text was ever different. The expression that is left fits
every page that went into it: its wrapper. In it, the article's elements are found (below), and each slot is text or not, for all pages of the host at once;
a page's slots are then read by aligning the page with the wrapper.

What is text: the slots within the article (article elements, else main ones, else elements named for content, else the deepest element that
holds most of the varying text outside links), without elements that are named or marked as menus, headers, footers, sidebars, notices, adverts, forms, comments and the like, without
lists that are all links, and without slots whose text is the same on all of at least ``same_on`` different pages. A page of which the wrapper takes no text is read by the wrapper of its own.

Wrappers are merged as a tree: each task merges its pages by host, then groups of at most ``at_once`` wrappers of a host are merged until one is left, so no host's pages meet in a task.

Defined cases: null and empty html give the empty text; pages without a host (null or malformed url) have each their own wrapper; repeated rows are read each;
elements nested deeper than ``DEEP`` count as part of the one at that depth; unclosed and stray tags as browsers read them; extra columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import cut

# Elements of HTML by how they lie on a page.
BLOCKS = frozenset("address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS, OUTER = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("html head body".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("audio button canvas datalist iframe label map noembed noframes noscript object optgroup option script select style svg template textarea title video".split())
#: Elements whose insides are no markup, and where these end.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in "iframe noembed noframes script style textarea title xmp".split()}
#: A comment, a tag (whether it ends, its name, its attributes), or a declaration.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAMED = re.compile(r"class|role|hidden|style", re.I)
#: Elements that an opening tag ends, up to the elements that hold them.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), **{t: ("thead tbody tfoot tr td th caption", "table") for t in ("thead", "tbody", "tfoot")}}
ENDS = {t: (frozenset(a.split()), frozenset(b.split())) for t, (a, b) in ENDS.items()}
#: Elements, roles and words of class and id of what is no text of an article.
NO_TEXT = frozenset("aside dialog fieldset footer form menu nav search".split())
NO_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NO_TEXT_WORDS = frozenset(
    "ad ads adsbygoogle adsense adslot advert advertisement advertising adverts alert alerts aside banner breadcrumb breadcrumbs colophon comment commentform commentlist comments consent cookie cookiebar cookies copyright crumbs "
    "discussion disqus footer form gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paging paywall popular popup promo "
    "promoted promotion recommended register related replies reply respond search share sharebar sharing sidebar signin signup skiplink social sponsor sponsored subscribe subscription tagcloud toast toolbar topbar trending widget widgets".split()
)
ARTICLE_WORDS = frozenset("article articlebody blogpost content entry main maincontent post postbody story text".split())
#: Depth to which elements are told apart, neighbours that repeat as a group at most, and items of an element beyond which their order is given up.
DEEP, PERIOD, ITEMS = 100, 6, 48
OPTIONAL, REPEATED, TEXT = 1, 2, 4
SLOT, ANY = "#", "(*)"


class Node:
    """An element or, with SLOT as its key, a run of text: its words, how many of their letters are in links, and its place on the page."""

    __slots__ = ("key", "kids", "text", "linked", "at")

    def __init__(self, key: str, text: str = "", linked: int = 0, at: int = 0):
        self.key, self.kids, self.text, self.linked, self.at = key, [], text, linked, at


#: Stands for elements below DEEP.
_FLAT = Node("")


@lru_cache(1 << 16)
def key_of(tag: str, given: str) -> str:
    """The element with its classes, id, role and whether it shows, numbers aside: tag.class#id@role!"""
    attrs: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(given):
        attrs.setdefault(name.lower(), html.unescape("".join(values)))
    named = "".join("." + c for c in sorted(set(attrs.get("class", "").split()))) + ("#" + "-".join(attrs["id"].split()) if attrs.get("id", "").strip() else "")
    role = attrs.get("role", "").strip().lower() or ("article" if attrs.get("itemprop", "").lower() == "articlebody" else "")
    style = attrs.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return tag + re.sub(r"[0-9]+", "0", named).replace("(", "") + (f"@{role}" if role else "") + "!" * hidden


@lru_cache(1 << 16)
def _unseen(tag: str, given: str) -> bool:
    """Whether inline markup is named as something that is no text."""
    return kind(key_of(tag, given).split("#")[0]) in ("no", "header")


@lru_cache(1 << 16)
def kind(key: str) -> str:
    """What a key says of its element: "no", "header", "article", "main", "content", or nothing."""
    m = re.fullmatch(r"([^.#@!]*)([^@!]*)(?:@([^!]*))?(!?)", key, re.S)
    tag, names, role, hidden = m.groups() if m else (key, "", "", "")
    words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower())
    said = {w for k, w in enumerate(words) if not (k and words[k - 1] in ("has", "no", "with", "without", "elementor"))}
    if hidden or tag in NO_TEXT or role in NO_TEXT_ROLES:
        return "no"
    if tag == "header" or "header" in said and not said & (NO_TEXT_WORDS - {"header"}):
        return "header"
    if tag == "article" and not said & {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo", "related"} or role == "article":
        return "article"
    if tag == "main" or role == "main":
        return "main"
    if said & NO_TEXT_WORDS:
        return "no"
    return "content" if said & ARTICLE_WORDS and tag in ("div", "section", "td") else ""


class Page:
    """The nested tokens of a page, as browsers read them: unclosed elements end where others may not be in them, stray ends are passed over."""

    def __init__(self, source: str):
        self.root = Node("")
        self.open: list[tuple[str, Node | None, bool]] = []  # tag, its element if that is a block, whether its text is unseen
        self.nodes, self.unseen, self.links, self.count = [self.root], 0, 0, 0
        self.held: list[str] = []
        self.held_linked = 0
        at = 0
        for m in iter(lambda: _TAG.search(source, at), None):
            if m.start() > at:
                self.words(source[at : m.start()])
            at, name = m.end(), m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self.ends(name)
            elif name in RAW:
                end = RAW[name].search(source, at)
                at = end.end() if end else len(source)
            else:
                self.starts(name, m[3])
        self.words(source[at:])
        self.flush()

    def words(self, text: str) -> None:
        if not self.unseen:
            text = html.unescape(text) if "&" in text else text
            self.held.append(text)
            if self.links:
                self.held_linked += len(text.strip())

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.count += 1
                self.nodes[-1].kids.append(Node(SLOT, text, min(self.held_linked, len(text)), self.count))
            self.held, self.held_linked = [], 0

    def shut(self, down_to: int) -> None:
        """Closes the open elements from that one on."""
        while len(self.open) > down_to:
            tag, node, unseen = self.open.pop()
            self.unseen -= unseen
            self.links -= tag == "a"
            if node is not None:
                self.flush()
                if node is not _FLAT:
                    self.nodes.pop()

    def starts(self, tag: str, given: str) -> None:
        if tag == "br":
            self.held.append(" ")
        if tag in OUTER or tag in VOID and tag != "hr":
            return
        if tag not in BLOCKS or self.unseen:
            if tag == "a":
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] == "a":
                        self.links -= 1
                        self.unseen -= self.open[i][2]
                        del self.open[i]
                self.links += 1
            unseen = tag in UNSEEN or not self.unseen and _NAMED.search(given) is not None and _unseen(tag, given)
            self.unseen += unseen
            self.open.append((tag, None, unseen))
            return
        self.flush()
        while self.open and self.open[-1][1] is None and not self.open[-1][2] and self.open[-1][0] != "a":
            self.shut(len(self.open) - 1)
        if tag in ENDS:
            mine, within = ENDS[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in within:
                    break
                if self.open[i][0] in mine:
                    self.shut(i)
        near = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][1] is not None), None)
        if near is not None and (self.open[near][0] == "p" or tag in HEADINGS and self.open[near][0] in HEADINGS):
            self.shut(near)
        if tag == "hr":
            return
        node = _FLAT
        if len(self.nodes) <= DEEP:
            node = Node(key_of(tag, given) if given.strip() else tag)
            self.nodes[-1].kids.append(node)
            self.nodes.append(node)
        self.open.append((tag, node, False))

    def ends(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag == "a":
                    self.links -= 1
                    self.unseen -= self.open[i][2]
                    del self.open[i]
                else:
                    self.shut(i)
                break
            if self.open[i][1] is not None and tag not in BLOCKS and tag != "a":
                break
        if tag in BLOCKS:
            self.flush()


class Item:
    """Nodes of one element that count as one item of an expression; parts: the items of a repeated group."""

    __slots__ = ("key", "nodes", "repeated", "parts")

    def __init__(self, key: str, nodes: list[Node], repeated: bool = False, parts: list[Item] | None = None):
        self.key, self.nodes, self.repeated, self.parts = key, nodes, repeated, parts

    def add(self, other: Item) -> None:
        self.repeated = True
        if self.parts:
            for p, q in zip(self.parts, other.parts):
                p.nodes.extend(q.nodes)
                p.repeated |= q.repeated
        self.nodes.extend(other.nodes)


def folded(nodes: list[Node]) -> list[Item]:
    """The items of an element: neighbours of one key, then runs of 2 to PERIOD neighbours that repeat, become one; beyond ITEMS, one group of any order."""
    items: list[Item] = []
    for node in nodes:
        if items and items[-1].key == node.key:
            items[-1].nodes.append(node)
            items[-1].repeated = True
        else:
            items.append(Item(node.key, [node]))
    for period in range(2, PERIOD + 1):
        if 2 * period > len(items):
            break
        keys, out, i = [x.key for x in items], [], 0
        while i < len(items):
            times = 1
            while keys[i : i + period] == keys[i + times * period : i + (times + 1) * period] and i + (times + 1) * period <= len(items):
                times += 1
            if times > 1:
                parts = items[i : i + period]
                for k in range(i + period, i + times * period):
                    parts[(k - i) % period].nodes.extend(items[k].nodes)
                    parts[(k - i) % period].repeated |= items[k].repeated
                out.append(Item("(" + " ".join(x.key for x in parts) + ")", [], True, parts))
                i += times * period
            else:
                out.append(items[i])
                i += 1
        items = out
    if len(items) > ITEMS:
        by: dict[str, Item] = {}
        for node in nodes:
            by.setdefault(node.key, Item(node.key, [], True)).nodes.append(node)
        items = [Item(ANY, [], True, [by[k] for k in sorted(by)])]
    return items


# An expression is a list of items [key, flags, expression within, statistics]; a slot's statistics: pages, least and largest hash of its text, letters, letters in links, runs of text.


def expression(nodes: list[Node]) -> list:
    return [_expressed(x) for x in folded(nodes)]


def _expressed(item: Item) -> list:
    flags = REPEATED * item.repeated
    if item.parts:
        return [item.key, REPEATED, [_expressed(p) for p in item.parts], None]
    if item.key == SLOT:
        hashes = [xxhash.xxh3_64_intdigest(n.text) >> 1 for n in item.nodes]
        return [SLOT, flags, None, [1, min(hashes), max(hashes), sum(len(n.text) for n in item.nodes), sum(n.linked for n in item.nodes), len(item.nodes)]]
    within: list | None = None
    for node in item.nodes:
        own = expression(node.kids)
        within = own if within is None else merged(within, own, True)
    return [item.key, flags, within, None]


def aligned(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of places of equal keys, as many as can be in order, elements before slots; and places of one side alone."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + (1 if a[i] == SLOT else 3) if a[i] == b[j] else 0)
    i = j = 0
    out: list[tuple[int | None, int | None]] = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + (1 if a[i] == SLOT else 3):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _unified(x: list, y: list, one_page: bool) -> list:
    """The item that fits what either fits."""
    stats = None
    if x[3]:
        (p, lo, hi, n, links, runs), (q, lo2, hi2, n2, links2, runs2) = x[3], y[3]
        stats = [max(p, q) if one_page else p + q, min(lo, lo2), max(hi, hi2), n + n2, links + links2, runs + runs2]
    return [x[0], x[1] | y[1], None if x[2] is None else merged(x[2], y[2], one_page), stats]


def merged(a: list, b: list, one_page: bool = False) -> list:
    """The expression that fits what either fits; one_page: both are of one page."""
    if a and a[0][0] == ANY or b and b[0][0] == ANY or len(a) + len(b) > 4 * ITEMS:
        return _any(a, b, one_page)
    out: list = []
    for i, j in aligned([x[0] for x in a], [x[0] for x in b]):
        x = _unified(a[i], b[j], one_page) if i is not None and j is not None else [*(a[i] if j is None else b[j])]
        if i is None or j is None:
            x[1] |= OPTIONAL
        if out and out[-1][0] == x[0]:
            out[-1] = _unified(out[-1], x, one_page)
            out[-1][1] |= REPEATED
        else:
            out.append(x)
    return _any(out, [], one_page) if len(out) > ITEMS else out


def _any(a: list, b: list, one_page: bool) -> list:
    """A repeated group of optional items in any order."""
    by: dict[str, list] = {}
    todo = [*a, *b]
    while todo:
        x = todo.pop()
        if x[0][:1] == "(":
            todo.extend(x[2])
            continue
        x = [x[0], x[1] | OPTIONAL | REPEATED, x[2], x[3]]
        by[x[0]] = _unified(by[x[0]], x, one_page) if x[0] in by else x
    return [[ANY, REPEATED, [by[k] for k in sorted(by)], None]]


def labelled(items: list, bodies: int, pages: int, same_on: int = 4) -> list:
    """The expression with TEXT set on the slots, and the elements, that are text. bodies: how many different pages it was made from, at least."""
    same = lambda x, repeated: not repeated and not x[1] & REPEATED and bodies >= same_on and x[3][0] >= same_on and 2 * x[3][0] >= pages and x[3][1] == x[3][2]

    def out_of_text(x: list, inside: bool) -> bool:
        k = kind(x[0]) if x[0][:1] not in ("#", "(") else ""
        return k == "no" or k == "header" and not inside or x[0][:1] not in ("#", "(") and all_links(x)

    def sums(x: list) -> tuple[int, int, float]:
        """Letters, those in links, and runs of text on a page."""
        if x[3]:
            return x[3][3], x[3][4], x[3][5] / x[3][0]
        each = [sums(y) for y in x[2]]
        return sum(e[0] for e in each), sum(e[1] for e in each), sum(e[2] for e in each)

    def all_links(x: list) -> bool:
        n, links, runs = sums(x)
        return n > 0 and links >= 0.9 * n and runs >= 3

    def weight(x: list, inside: bool = False, repeated: bool = False) -> int:
        """Letters outside links that may be text."""
        if x[3]:
            return 0 if same(x, repeated) else x[3][3] - x[3][4]
        if out_of_text(x, inside):
            return 0
        return sum(weight(y, inside or kind(x[0]) in ("article", "main"), repeated or bool(x[1] & REPEATED)) for y in x[2] or [])

    def outermost(x: list, wanted: str, inside: bool = False) -> list:
        if x[3] or out_of_text(x, inside):
            return []
        if x[0][:1] != "(" and kind(x[0]) == wanted:
            return [x]
        return [z for y in x[2] or [] for z in outermost(y, wanted, inside or kind(x[0]) == "main")]

    def heads(x: list) -> bool:
        """Whether there is a first-level heading."""
        return not x[3] and (x[0].startswith("h1") or any(heads(y) for y in x[2] or []))

    def inner(x: list) -> list:
        """The innermost element named for content that holds most of x and its heading."""
        while there := [z for y in x[2] for z in outermost(y, "content", True)]:
            most = max(there, key=lambda z: weight(z, True))
            if weight(most, True) < 0.75 * weight(x, True) or heads(x) and not heads(most):
                break
            x = most
        return x

    root = ["", 0, items, None]
    total = weight(root)
    roots: list = []
    for wanted, least in (("article", 0.3), ("main", 0.3), ("content", 0.5)):
        if not roots:
            there = [(weight(x, wanted != "content"), x) for x in outermost(root, wanted)]
            if there and sum(w for w, _ in there) >= max(least * total, 1):
                roots = [x for w, x in there if 4 * w >= max(w for w, _ in there)]
                roots = roots if wanted == "article" else [inner(x) for x in roots]
    if not roots and total:
        here = root
        while True:
            most = max((y for y in here[2] or [] if not y[3]), key=weight, default=None)
            if most is None or weight(most) < 0.85 * weight(here) or re.match(r"(p|h[1-6]|li|ul|ol|dl|dt|dd|table|tbody|tr|td|th|blockquote|pre|figure)\b", most[0]) or any(heads(y) for y in here[2] if y is not most):
                break
            here = most
        roots = [here]
    chosen = {id(x) for x in roots}

    def mark(x: list, text: bool, inside: bool, repeated: bool) -> list:
        text = text or id(x) in chosen
        if x[3]:
            return [x[0], (x[1] & ~TEXT) | TEXT * (text and not same(x, repeated)), None, x[3]]
        if id(x) not in chosen and out_of_text(x, inside):
            text = False
            return [x[0], x[1] & ~TEXT, [mark(y, False, inside, repeated) for y in x[2]] if any(id(z) in chosen for z in _all(x)) else [], None]
        inside, repeated = inside or text or kind(x[0]) in ("article", "main"), repeated or bool(x[1] & REPEATED)
        return [x[0], (x[1] & ~TEXT) | TEXT * text, [mark(y, text, inside, repeated) for y in x[2] or []], None]

    return mark(root, False, False, False)[2] if id(root) not in chosen else mark(root, True, False, False)[2]


def _all(x: list) -> Iterator[list]:
    yield x
    for y in x[2] or []:
        yield from _all(y)


def taken(nodes: list[Node], wrapper: list, text: bool = False) -> Iterator[Node]:
    """The slots of a page that are text by the wrapper: the page's items aligned with its; what it doesn't hold goes as the element around it."""
    yield from _taken(folded(nodes), wrapper, text)


def _taken(items: list[Item], wrapper: list, text: bool) -> Iterator[Node]:
    flat: dict[str, list] | None = None
    for i, j in aligned([x.key for x in items], [x[0] for x in wrapper]):
        if i is None:
            continue
        item, own = items[i], None if j is None else wrapper[j]
        if own is None:
            if flat is None:  # a single one of a repeated group, or of a group of any order
                flat, todo = {}, [*wrapper]
                while todo:
                    y = todo.pop(0)
                    flat.setdefault(y[0], y)
                    todo.extend(y[2] if y[0][:1] == "(" else [])
            own = flat.get(item.key)
        if item.parts:
            yield from _taken(item.parts, [*flat.values()] if own is None and flat else own[2] if own else [], text)
            continue
        good = bool(own[1] & TEXT) if own else text and (item.key == SLOT or kind(item.key) not in ("no",))
        if item.key == SLOT:
            if good:
                yield from item.nodes
            continue
        for node in item.nodes:
            yield from taken(node.kids, own[2] if own else [], good)


def own_wrapper(page: Page) -> list:
    return labelled(expression(page.root.kids), 1, 1)


def text_of(source: str, wrapper: list | None) -> str:
    page = Page(source)
    found = sorted(taken(page.root.kids, wrapper), key=lambda n: n.at) if wrapper is not None else []
    if not found and page.count:
        found = sorted(taken(page.root.kids, own_wrapper(page)), key=lambda n: n.at)
    return "\n\n".join(n.text for n in found)


class Merger:
    """Expressions by host with how many pages they are of and the least hashes of these, each once; equal ones are added up before any are aligned."""

    def __init__(self, same_on: int):
        self.same_on, self.held = same_on, {}

    def add(self, host: str, items: list, pages: int, bodies: list[int]) -> None:
        own = self.held.setdefault(host, {})
        shape = json.dumps(_bare(items))
        if shape in own:
            was, n, seen = own[shape]
            items, pages, bodies = merged(was, items), n + pages, sorted({*seen, *bodies})[: self.same_on]
        own[shape] = (items, pages, bodies)

    def results(self) -> Iterator[tuple[str, list, int, list[int]]]:
        for host in sorted(self.held):
            items, pages, bodies = None, 0, []
            for shape in sorted(self.held[host], key=lambda s: (len(s), s)):
                own, n, seen = self.held[host][shape]
                items = own if items is None else merged(items, own)
                pages, bodies = pages + n, sorted({*bodies, *seen})[: self.same_on]
            yield host, items, pages, bodies
        self.held = {}


def _bare(items: list) -> list:
    return [[x[0], x[1], _bare(x[2]) if x[2] else 0] for x in items]


WRAPPER = "host string, wrapper string, pages long, bodies array<long>, part int"


def infer(pages: DataFrame, same_on: int = 4, at_once: int = 64, hosts_at_once: int = 2_000) -> DataFrame:
    """host, wrapper (labelled, as JSON) for each host of pages (host, html)."""

    def rows(merger: Merger, part: int) -> Iterator[pa.RecordBatch]:
        found = list(merger.results())
        if found:
            host, items, n, bodies = zip(*found)
            yield pa.record_batch([pa.array(host), pa.array([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in items]), pa.array(n, pa.int64()), pa.array(bodies, pa.list_(pa.int64())), pa.array([part] * len(host), pa.int32())], ["host", "wrapper", "pages", "bodies", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, part = Merger(same_on), 0
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source)
                body = xxhash.xxh3_64_intdigest("\n".join(n.text for n in _slots(page.root))) >> 1
                merger.add(host, expression(page.root.kids), 1, [body])
            if len(merger.held) > hosts_at_once:
                yield from rows(merger, part)
                part += 1
        yield from rows(merger, part)

    def meet(table: pa.Table) -> pa.Table:
        merger = Merger(same_on)
        for host, wrapper, n, bodies in sorted(zip(*(table.column(c).to_pylist() for c in ("host", "wrapper", "pages", "bodies")))):
            merger.add(host, json.loads(wrapper), n, bodies)
        return pa.Table.from_batches(list(rows(merger, 0)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = [json.dumps(_bare(labelled(json.loads(w), len(b), n, same_on)), ensure_ascii=False, separators=(",", ":")) for w, n, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.record_batch([batch.column(0), pa.array(marked, pa.string())], ["host", "wrapper"])

    found = cut(pages.where("host IS NOT NULL AND html <> ''").select("host", "html").mapInArrow(read, WRAPPER))
    while (most := found.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        sized = found.join(found.groupBy("host").agg(F.count("*").alias("_n")), "host")
        bucket = F.pmod(F.xxhash64("wrapper", "part"), F.ceil(F.col("_n") / at_once).cast("long")) if most > at_once else F.lit(0)
        found = cut(sized.withColumn("_bucket", bucket).drop("_n").groupBy("host", "_bucket").applyInArrow(meet, WRAPPER))
    return found.mapInArrow(label, "host string, wrapper string")


def _slots(node: Node) -> Iterator[Node]:
    for kid in node.kids:
        if kid.key == SLOT:
            yield kid
        else:
            yield from _slots(kid)


def extract(pages: DataFrame, *, same_on: int = 4, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars of each of pages (page_id, url, html)."""
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    wrappers = cut(infer(rows, same_on))
    small = (wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64)).first()[0] or 0) <= broadcast_bytes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper is not None and wrapper not in known:
                    if len(known) > 256:
                        known.clear()
                    known[wrapper] = _loaded(json.loads(wrapper))
                texts.append(text_of(source, known.get(wrapper)) if source else "")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(F.broadcast(wrappers) if small else wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(read, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def _loaded(items: list) -> list:
    return [[key, flags, _loaded(within) if within else []] for key, flags, within in items]
