"""Main text of web pages by wrappers inferred for each host.

A page's tags form a tree of block elements (tag, first class or id) with text slots. Pages of one host
are aligned pairwise and iteratively: where the streams of two lists of elements agree, element meets
element; a mismatch is resolved by making equal neighbours, or runs of them, repeated groups, and what one
side still lacks optional; text becomes slots with statistics. No alternatives arise, so the result is a
union-free regular expression, the wrapper (`render`).

Which slots hold the article is decided once per wrapper (`decide`): menus, adverts and the like are out by
their names, of the rest the text that stays the same on different pages belongs to the site, and where no
element says that it is the article, it is the smallest part of the wrapper with most of the text that
varies. Every page is then matched with its host's wrapper (`match`), and its texts share the fate of their slots.

Workers merge the pages of a task into a wrapper per host, and partial wrappers are merged in two grouped
steps, so a hot host costs no more than its number of tasks.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.llm.common import materialize, table

#: Elements whose text is never part of an article, elements without content, inline elements.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "object", "canvas")
DROP = {"nav", "footer", "aside", "form", "head", "title", "button", "select", "option", "dialog", "menu", "label", "fieldset", *RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in a class, id or role that mark what is not the article.
DROP_WORDS = {
    "nav", "navbar", "navigation", "menu", "sidebar", "aside", "footer", "header", "masthead", "ad", "ads", "advert", "adverts", "advertisement", "banner",
    "cookie", "cookies", "consent", "notice", "notices", "alert", "promo", "promotion", "sponsor", "sponsored", "related", "recommended", "share", "sharing",
    "social", "comment", "comments", "respond", "reply", "replies", "discussion", "subscribe", "subscription", "newsletter", "signup", "login", "form",
    "search", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "popup", "modal", "overlay", "toolbar", "copyright", "disclaimer", "skip",
    "complementary", "contentinfo", "disqus", "feedback", "paywall", "gdpr",
}
MAIN_WORDS = {"article", "post", "story", "entry", "main", "content", "articlebody"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_RAW = "|".join(RAW)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    # A quote opens a value only after =, and only if it is closed somewhere; else it is a character like others.
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attributes>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>|</?[A-Za-z][^>]*\Z|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Hosts whose partial wrappers a task holds at once, and parts of a host that the first merge keeps apart.
HELD_HOSTS, PARTS = 5000, 64
#: Depth from which on elements are not told apart.
DEPTH = 100
#: Elements for running text: within an article they count even if their text never varies.
PROSE = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "caption", "blockquote", "pre", "figcaption", "summary", "address"}
#: Equal neighbours from which on they are a repeated group by themselves.
LONG_RUN = 32
#: Cells up to which the longest common order of two lists is sought; beyond, elements meet the next equal one.
MOST_CELLS = 250_000
#: Wrappers that may be broadcast, in rows and characters, and parts in which hosts are joined otherwise.
FEW_HOSTS, FEW_CHARS, SALTS = 50_000, 32_000_000, 16


def scan(page: str) -> Iterator[tuple[tuple[str, ...] | None, str, bool, tuple[int, ...]]]:
    """(path, text, in a link, numbers of the path's elements) of each text; the path is None at each block boundary.

    A path is the chain of block elements, as tag or tag.name; inline elements are in it only if their
    names mark them as something to drop.
    """
    stack: list[tuple[str, str | None]] = []  # tag, element in the path
    path: list[str] = []
    numbers: list[int] = []
    links = opened = 0

    def pop() -> None:
        nonlocal links
        tag, element = stack.pop()
        if element is not None:
            path.pop()
            numbers.pop()
        links -= tag == "a"

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            yield tuple(path), html.unescape(text) if "&" in text else text, links > 0, tuple(numbers)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        block = tag not in INLINE
        if tag == "br":
            yield tuple(path), " ", links > 0, tuple(numbers)
            continue
        if block:
            yield None, "", False, ()
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        closes = _CLOSES.get(tag, set())
        if block and any(t == "p" for t, _ in stack[-8:]):
            closes = closes | {"p"}
        if closes:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in closes:
                    while len(stack) > depth:
                        pop()
                    if "p" not in closes or tag not in _CLOSES:
                        break
                elif stack[depth][0] not in INLINE and stack[depth][0] not in ("td", "th", "p", "dt", "dd"):
                    break
        names = {} if not m["attributes"] or "=" not in m["attributes"] else {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(m["attributes"])}
        words = {w for name in names.values() for w in _WORD.findall(name.lower())}
        first = next((n.split()[0].lower() for k in ("class", "id", "role", "itemprop") if (n := names.get(k, "")).strip()), "")
        element = f"{tag}.{first}" if first else tag
        if words & DROP_WORDS:
            element = f"{tag}.-{first}"  # the minus sign: named as not the article
        elif words & MAIN_WORDS:
            element = f"{tag}.+{first}"
        # Elements nested deeper than any layout belong to the one above; those that drop text still count.
        drops = tag in DROP or bool(words & DROP_WORDS)
        in_path = (block and len(path) < DEPTH) or (drops and len(path) < 2 * DEPTH)
        stack.append((tag, element if in_path else None))
        if in_path:
            path.append(element)
            opened += 1
            numbers.append(opened)
        links += tag == "a"


def _dropped(path: tuple[str, ...] | list[str]) -> bool:
    """Whether a path runs through something that is not the article."""
    inside = False
    for element in path:
        tag, _, name = element.partition(".")
        inside |= tag in ("article", "main")
        if tag in DROP or name.startswith("-"):
            return True
        if tag == "header" and not (inside and path[-1].partition(".")[0] in HEADINGS):
            return True
    return False


def _rank(path: tuple[str, ...] | list[str]) -> int:
    """How clearly a path is in an article: 3 article, 2 main, 1 so named, 0 not."""
    tags = {e.partition(".")[0] for e in path}
    return 3 if "article" in tags else 2 if "main" in tags else 1 if any(".+" in e for e in path) else 0


# A wrapper element is [name, optional, repeated, children]; a slot is ["#", optional, repeated, statistics]
# with statistics [characters, characters in links, least and greatest text hash, least and greatest hash of
# the pages it is on]; a group of several repeated elements is ["()", optional, True, children].


def tree(events: list[tuple]) -> list:
    """The elements of a page (from `scan`), ["", False, False, children], with slots ["#", False, False, places of events]."""
    root: list = ["", False, False, []]
    open_: list[list] = [root]
    last: tuple[int, ...] = ()
    for i, (where, text, _, numbers) in enumerate(events):
        if where is None:
            continue
        common = 0
        while common < min(len(last), len(numbers)) and last[common] == numbers[common]:
            common += 1
        blank = not text.strip()
        if blank and (common < len(numbers) or len(last) > common):
            continue  # white space where an element begins or ends
        del open_[common + 1 :]
        for element in where[common:]:
            node: list = [element, False, False, []]
            open_[-1][3].append(node)
            open_.append(node)
        last = numbers
        inner = open_[-1][3]
        if inner and inner[-1][0] == "#":
            inner[-1][3].append(i)
        elif not blank:
            inner.append(["#", False, False, [i]])
    return root


def build(page: str) -> list:
    """The wrapper of one page."""
    events = list(scan(page))
    root = tree(events)
    own = xxhash.xxh3_64_intdigest(page) >> 1
    todo, order = [root], []
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node[3] if c[0] != "#"]
    for node in reversed(order):
        for slot in node[3]:
            if slot[0] == "#":
                texts = [events[i] for i in slot[3]]
                text = " ".join("".join(t for _, t, _, _ in texts).split())
                h = xxhash.xxh3_64_intdigest(text) >> 1
                slot[3] = [len(text), min(len(text), sum(len(t.strip()) for _, t, link, _ in texts if link)), h, h, own, own]
        node[3] = _short_runs(node[3])
    return root


def _short_runs(nodes: list) -> list:
    """nodes with runs of LONG_RUN or more equal neighbours as one repeated element each."""
    out: list = []
    a = 0
    while a < len(nodes):
        b = a + 1
        while b < len(nodes) and _same(nodes[b], nodes[a]):
            b += 1
        if b - a < LONG_RUN:
            out += nodes[a:b]
        else:
            one = nodes[a]
            for x in nodes[a + 1 : b]:
                one = merge(one, [x[0], False, *x[2:]], repeated=x[0] != "#")
            out.append([one[0], all(x[1] for x in nodes[a:b]), *one[2:]])
        a = b
    return out


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "()" or [x[0] for x in a[3]] == [x[0] for x in b[3]])


def _alike(a: list, b: list) -> bool:
    """Whether two equal elements have children of the same names, so that they may be one element repeated."""
    return _same(a, b) and (a[0] in ("#", "()") or {c[0] for c in a[3]} == {c[0] for c in b[3]})


def _pooled(x: list, y: list) -> list:
    return [x[0] + y[0], x[1] + y[1], min(x[2], y[2]), max(x[3], y[3]), min(x[4], y[4]), max(x[5], y[5])]


def merge(a: list, b: list, repeated: bool = False) -> list:
    """The element that stands for both of two equally named ones."""
    flags = [a[1] or b[1], a[2] or b[2] or repeated]
    if a[0] == "#":
        x, y = a[3], b[3]
        return ["#", *flags, _pooled(x, y)]
    return [a[0], *flags, align(a[3], b[3])]


def _grouped(nodes: list, other: list) -> list:
    """nodes with runs that other has as a repeated group made into that group."""
    for group in (x for x in other if x[0] == "()"):
        names = [x[0] for x in group[3]]
        out, i = [], 0
        while i < len(nodes):
            if [x[0] for x in nodes[i : i + len(names)]] == names:
                out.append(["()", False, False, nodes[i : i + len(names)]])
                i += len(names)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list, b: list) -> list:
    """Two lists of elements as one: element by element if they agree, else equal elements merged in a common order. What
    one list lacks is a repetition of its neighbours if it is alike, else optional."""
    if len(a) == len(b) and all(map(_same, a, b)):
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    head = 0
    while head < min(len(a), len(b)) and _same(a[head], b[head]) and _likeness(a[head], b[head]) == 7:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and _same(a[-1 - tail], b[-1 - tail]) and _likeness(a[-1 - tail], b[-1 - tail]) == 7:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    pairs += [(head + i, head + j) for i, j in _common(a[head : len(a) - tail], b[head : len(b) - tail])]
    pairs += [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]
    both = []  # element, and whether one list lacks it
    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        both += [(n, True) for n in (*a[i:x], *b[j:y])]
        if x < len(a):
            both.append((merge(a[x], b[y]), False))
        i, j = x + 1, y + 1
    return _short_runs(_resolved(both))


def _resolved(both: list[tuple[list, bool]]) -> list:
    """Elements of which some are lacking in one list (True): repetitions of those before or after, or optional ones."""
    out: list = []
    i = 0
    while i < len(both):
        node, lacking = both[i]
        i += 1
        if not lacking:
            out.append(node)
        elif out and _alike(out[-1], node):
            out[-1] = merge(out[-1], [node[0], False, *node[2:]], repeated=node[0] != "#")
        elif i < len(both) and _alike(node, both[i][0]) and not both[i][1]:
            after = both[i][0]
            both[i] = (merge([node[0], after[1], *node[2:]], after, repeated=node[0] != "#"), False)
        else:
            for width in (2, 3, 4):
                run = [x for x, gone in both[i - 1 : i - 1 + width] if gone]
                group = out[-1][3] if out and out[-1][0] == "()" else []
                if len(run) == width == len(group) and all(map(_alike, group, run)):
                    out[-1][3] = [merge(x, y) for x, y in zip(group, run, strict=True)]
                    out[-1][2] = True
                elif len(run) == width <= len(out) and all(x[0] != "()" and _alike(x, y) for x, y in zip(out[-width:], run, strict=True)):
                    out[-width:] = [["()", False, True, [merge(x, y) for x, y in zip(out[-width:], run, strict=True)]]]
                else:
                    continue
                i += width - 1
                break
            else:
                out.append([node[0], True, *node[2:]])
    return out


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of equal elements in a common order: the longest one, or for very long lists a good one."""
    if not a or not b:
        return []
    if len(a) * len(b) > MOST_CELLS:
        places: dict[str, list[int]] = {}
        for j, y in enumerate(b):
            places.setdefault(json.dumps([y[0], [c[0] for c in y[3]] if y[0] == "()" else 0]), []).append(j)
        out, least = [], 0
        for i, x in enumerate(a):
            there = places.get(json.dumps([x[0], [c[0] for c in x[3]] if x[0] == "()" else 0]), [])
            k = bisect_left(there, least)
            if k < len(there) and there[k] - least <= len(b) - len(a) + 64:
                out.append((i, there[k]))
                least = there[k] + 1
        return out
    # Among common orders the one whose elements are most alike: children of the same names, the same text.
    most = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            most[i][j] = max(most[i + 1][j], most[i][j + 1])
            if _same(a[i], b[j]):
                most[i][j] = max(most[i][j], most[i + 1][j + 1] + _likeness(a[i], b[j]))
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if _same(a[i], b[j]) and most[i][j] == most[i + 1][j + 1] + _likeness(a[i], b[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif most[i][j] == most[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _likeness(a: list, b: list) -> int:
    texts = [[c[3][2:4] for c in x[3] if c[0] == "#"] for x in (a, b)] if a[0] != "#" else [[a[3][2:4]], [b[3][2:4]]]
    return 4 + 2 * _alike(a, b) + (texts[0] == texts[1] != [])


def render(node: list) -> str:
    """A wrapper as a regular expression: elements with their children, # for text, ? and + for groups."""
    name, optional, repeated, inner = node
    body = "#PCDATA" if name == "#" else " ".join(map(render, inner)) if name in ("", "()") else f"<{name}>{' '.join(map(render, inner))}</>"
    sign = "*" if optional and repeated else "?" if optional else "+" if repeated else ""
    return f"({body}){sign}" if sign else body


def _slots(wrapper: list) -> list[tuple[tuple[str, ...], list, tuple[list, ...]]]:
    """path, slot and elements around it (outermost first) of all slots."""
    out: list[tuple[tuple[str, ...], list, tuple[list, ...]]] = []
    todo: list[tuple[tuple[str, ...], tuple[list, ...], list]] = [((), (wrapper,), wrapper)]
    while todo:
        path, around, node = todo.pop()
        for child in node[3]:
            if child[0] == "#":
                out.append((path, child, around))
            else:
                todo.append((path if child[0] == "()" else (*path, child[0]), (*around, child), child))
    return out


def decide(wrapper: list, varied: bool) -> list:
    """The wrapper's rules [name, repeated, children], with slots ["#", fate]: 1 for the article, 2 for it on pages
    that have nothing of fate 1, 3 on pages that have neither, 0 for what is never in it.

    Slots in menus, adverts and the like are out. Article elements come before main elements before so
    named ones; in them prose stays, and other text if it varies. Else the article is what varies, is not mostly links, and
    lies in the smallest element that has more than half of such text; on pages without that element, what
    varies and is not mostly links anywhere. Text varies unless it is the same on different pages; if all
    pages of a host are copies (not varied), all text counts.
    """
    every = _slots(wrapper)
    open_ = [x for x in every if not _dropped(x[0])]
    best = max((_rank(p) for p, _, _ in open_), default=0)
    own = lambda s: varied and s[2] == s[3] and s[4] != s[5]
    fates = {id(slot): 0 for _, slot, _ in every}
    others = [x for x in open_ if 2 * x[1][3][1] <= x[1][3][0] and not own(x[1][3])]
    inside: dict[int, int] = {}
    for _, slot, around in others:
        for node in around:
            inside[id(node)] = inside.get(id(node), 0) + slot[3][0]
    whole = inside.get(id(wrapper), 0)
    root = wrapper
    while below := [c for c in root[3] if c[0] != "#" and 2 * inside.get(id(c), 0) > whole]:
        root = below[0]
    for _, slot, around in others:
        fates[id(slot)] = 2 if any(n is root for n in around) else 3
    for path, slot, _ in open_:
        if best and _rank(path) == best and (path[-1].partition(".")[0] in PROSE or not own(slot[3])):
            fates[id(slot)] = 1

    def rules(node: list, path: tuple[str, ...]) -> list:
        if node[0] == "#":
            return ["#", fates[id(node)]]
        path = path if node[0] in ("", "()") else (*path, node[0])
        inner = [] if _dropped(path) and path[-1].partition(".")[0] != "header" else [rules(c, path) for c in node[3]]
        return [node[0], node[2], inner]

    return rules(wrapper, ())


def match(rules: list, page: list, fates: list[int], by_path: dict[tuple[str, ...], int]) -> None:
    """Sets the fates of a page's texts (places of events in `tree`) by matching its elements with a wrapper's rules.

    What the rules lack (a page that the wrapper has not seen) has the fate of slots on the same path.
    """
    todo: list[tuple[list | None, list, tuple[str, ...]]] = [(rules, page, ())]
    while todo:
        rule, node, path = todo.pop()
        for child, found in zip(node[3], _matched(rule[2], node[3]) if rule else [None] * len(node[3]), strict=True):
            if child[0] == "#":
                fate = found[1] if found else by_path.get(path, 0)
                for i in child[3]:
                    fates[i] = fate
            else:
                todo.append((found, child, (*path, child[0])))


def _matched(rules: list, nodes: list) -> list[list | None]:
    """The rule of each element of a list."""
    if len(rules) == len(nodes) and all(r[0] == n[0] for r, n in zip(rules, nodes, strict=True)):
        return list(rules)
    flat = [(c, g) for g, r in enumerate(rules) for c in (r[2] if r[0] == "()" else [r])]
    by_name: dict[str, list[int]] = {}
    for k, (c, _) in enumerate(flat):
        by_name.setdefault(c[0], []).append(k)
    if all(len(x) == 1 for x in by_name.values()):
        return [flat[by_name[n[0]][0]][0] if n[0] in by_name else None for n in nodes]
    # The order with the most elements matched; then with the fewest rules passed over. A repeated rule, or a group, may be met again.
    again = [rules[g][0] == "()" or (c[0] != "#" and c[1]) for c, g in flat]
    first = {g: k for k, (_, g) in reversed(list(enumerate(flat)))}
    best: dict[int, tuple[int, tuple | None]] = {-1: (0, None)}  # last rule met -> cost, chain
    for n in nodes:
        new: dict[int, tuple[int, tuple | None]] = {}
        for last, (cost, chain) in best.items():
            options = [(last, cost + 1000, None)]
            for k in by_name.get(n[0], ()):
                if k > last or (k == last and again[k] and rules[flat[k][1]][0] != "()"):
                    options.append((k, cost + max(0, k - last - 1), flat[k][0]))
                elif last >= 0 and flat[k][1] == flat[last][1] and rules[flat[k][1]][0] == "()":
                    options.append((k, cost + k - first[flat[k][1]], flat[k][0]))  # the group once more
            for k, price, rule in options:
                if k not in new or price < new[k][0]:
                    new[k] = (price, (rule, chain))
        best = new
    _, chain = min(best.values(), key=lambda x: x[0])
    out: list[list | None] = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


class Rules:
    """A wrapper's rules, ready for pages."""

    def __init__(self, rules: list):
        self.rules = rules
        self.by_path: dict[tuple[str, ...], int] = {}
        todo: list[tuple[tuple[str, ...], list]] = [((), rules)]
        while todo:
            path, node = todo.pop()
            for child in node[2]:
                if child[0] == "#":
                    if child[1]:
                        self.by_path[path] = min(child[1], self.by_path.get(path, 3))
                else:
                    todo.append((path if child[0] == "()" else (*path, child[0]), child))

    def extract(self, page: str | None) -> str:
        """The article of a page: blocks joined by line feeds, white space made single."""
        if not page:
            return ""
        events = list(scan(page))
        fates = [0] * len(events)
        match(self.rules, tree(events), fates, self.by_path)
        blocks: list[list[str]] = [[], [], []]  # by fate
        now: list[list[str]] = [[], [], []]
        for (path, text, _, _), fate in [*zip(events, fates, strict=True), ((None, "", False, ()), 0)]:
            if path is None:
                for parts, out in zip(now, blocks, strict=True):
                    if parts:
                        if joined := " ".join("".join(parts).split()):
                            out.append(joined)
                        parts.clear()
            elif fate:
                now[fate - 1].append(text)
        return "\n".join(next(filter(None, blocks), []))


_PARTIAL = "host string, part int, pages long, lo long, hi long, wrapper string"


def _merged(table: pa.Table) -> dict:
    wrapper = None
    for text in table.column("wrapper").to_pylist():
        one = json.loads(text)
        wrapper = one if wrapper is None else merge(wrapper, one)
    return {
        "host": [table.column("host")[0].as_py()],
        "pages": [sum(table.column("pages").to_pylist())],
        "lo": [min(table.column("lo").to_pylist())],
        "hi": [max(table.column("hi").to_pylist())],
        "wrapper": [wrapper],
    }


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper, rules: one row per host of pages (url, html).

    wrapper is the host's union-free regular expression; rules is the JSON that `decide` gives. Null pages take no part; pages without a host share the host ''; repeated pages are merged
    again, but pages that are all copies of one do not make its text constant.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        part = TaskContext.get().partitionId() % PARTS

        def out() -> pa.RecordBatch:
            rows = [(host, part, n, lo, hi, json.dumps(w)) for host, (n, lo, hi, w) in held.items()]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _PARTIAL.split(", ")])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = page.as_py()
                h = xxhash.xxh3_64_intdigest(text) >> 1
                one = build(text)
                if host in held:
                    n, lo, hi, w = held[host]
                    held[host] = [n + 1, min(lo, h), max(hi, h), merge(w, one)]
                else:
                    held[host] = [1, h, h, one]
                if len(held) >= HELD_HOSTS:
                    yield out()
        if held:
            yield out()

    def again(table: pa.Table) -> pa.Table:
        x = _merged(table)
        return pa.table({**x, "part": table.column("part").slice(0, 1), "wrapper": [json.dumps(x["wrapper"][0])]}).select([c.split()[0] for c in _PARTIAL.split(", ")])

    def final(table: pa.Table) -> pa.Table:
        x = _merged(table)
        rules = json.dumps(decide(x["wrapper"][0], x["lo"] != x["hi"]))
        return pa.table({"host": x["host"], "pages": x["pages"], "wrapper": [render(x["wrapper"][0])], "rules": [rules]})

    rows = pages.filter("html IS NOT NULL").select(_host(), "html")
    parts = rows.mapInArrow(partial, _PARTIAL).groupBy("host", "part").applyInArrow(again, _PARTIAL)
    return parts.groupBy("host").applyInArrow(final, "host string, pages long, wrapper string, rules string")


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)), F.lit("")).alias("host")


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, text, n_chars: the article of each page.

    A null or empty page has an empty text; repeated rows and null ids or urls are kept; other columns are
    ignored; an empty table gives an empty result.
    """
    rules = materialize(spark, infer_wrappers(pages).select("host", "rules"), "wrappers")
    size = rules.limit(FEW_HOSTS + 1).agg(F.count("*").alias("n"), F.sum(F.length("rules")).alias("c")).first()
    rows = pages.select("page_id", "url", "html", _host())
    if size["n"] <= FEW_HOSTS and (size["c"] or 0) <= FEW_CHARS:
        rows = rows.join(F.broadcast(rules), "host", "left")
    else:  # a hot host's pages go to several tasks
        rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(rules, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Rules] = {}
        for batch in batches:
            texts = []
            for page, own in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if own not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    known[own] = Rules(json.loads(own) if own else ["", False, []])
                texts.append(known[own].extract(page.as_py()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "rules").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(spark, table(spark, sf_dir, "pages"))
