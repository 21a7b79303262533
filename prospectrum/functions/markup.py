"""One page of HTML to its parts; the helper of operators/documents.py."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from html.parser import HTMLParser
from itertools import accumulate

from prospectrum import constants as C

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open one of the second.
ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_BUSINESS = re.compile(f"(?:{C.BUSINESS_PATTERN})|(?:{C.EMAIL_PATTERN})|(?:{C.PHONE_PATTERN})", re.IGNORECASE)
_BUSINESS_AT = re.compile(f"(?=({_BUSINESS.pattern}))", re.IGNORECASE)
#: For texts without an at sign, in which no address is looked for at each character.
_BUSINESS_NO_MAIL_AT = re.compile(f"(?=((?:{C.BUSINESS_PATTERN})|(?:{C.PHONE_PATTERN})))", re.IGNORECASE)
_JSON_LD = re.compile(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.IGNORECASE | re.DOTALL)


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def every(self, *tags: str) -> list[Node]:
        """Elements below, in document order."""
        out, stack = [], [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            if not tags or node.tag in tags:
                out.append(node)
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        return out

    def raw(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def text(self) -> str:
        return " ".join(self.raw().split())

    def marker(self) -> str:
        return f"{self.attrs.get('id', '')} {self.attrs.get('class', '')}".lower()

    def is_main(self) -> bool:
        return self.tag in ("main", "article") or self.attrs.get("role") == "main"


_REACH = 256


class Tour:
    """A tree in document order: each element is a span of the texts and of the
    elements, so what is below it is told from prefix sums.

    An element's text is white-space-squeezed, as ``Node.text`` gives it. Where the
    pattern of protected text starts and ends in the whole text says whether an
    element's own holds it; only at an element's edges, where its text is cut
    off, is the pattern tried again (on ``_REACH`` characters).
    """

    def __init__(self, root: Node):
        pieces, self.span, self.place, tags = [], {}, {}, []
        at, stack = 0, [(root, False)]
        while stack:
            node, left = stack.pop()
            if isinstance(node, str):
                pieces.append(node)
                at += len(node)
            elif left:
                self.span[node][1] = at
                self.place[node][1] = len(tags)
            else:
                tags.append(node.tag)
                self.span[node], self.place[node] = [at, 0], [len(tags), 0]
                stack.append((node, True))
                stack += [(c, False) for c in reversed(node.children)]
        words = [m.span() for m in re.finditer(r"\S+", "".join(pieces))]
        raw = "".join(pieces)
        self.starts, self.ends = [s for s, _ in words], [e for _, e in words]
        self.shown = list(accumulate((e - s + 1 for s, e in words), initial=0))
        self.text = " ".join(raw[s:e] for s, e in words)
        self.counts = {tag: list(accumulate((t == tag for t in tags), initial=0)) for tag in ("a", "h1", "li")}
        linked = [t == "li" for t in tags]
        for node, (first, end) in self.place.items():
            if node.tag == "li" and not self._count("a", first, end):
                linked[first - 1] = False
        self.counts["linked li"] = list(accumulate(linked, initial=0))
        self._hits: tuple[list[int], list[int]] | None = None
        self._edges: dict[tuple[int, int], bool] = {}

    def _count(self, tag: str, first: int, end: int) -> int:
        return self.counts[tag][end] - self.counts[tag][first]

    def below(self, node: Node, tag: str | None = None) -> int:
        """Elements below a node, of a tag or all."""
        first, end = self.place[node]
        return end - first if tag is None else self._count(tag, first, end)

    def shown_span(self, node: Node) -> tuple[int, int, int]:
        """Where a node's text starts and ends in all text, and its words."""
        a, b = self.span[node]
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b) - 1
        if i > j or a == b:
            return 0, 0, 0
        return self.shown[i] + max(0, a - self.starts[i]), self.shown[j] + min(b, self.ends[j]) - self.starts[j], j - i + 1

    def is_protected(self, node: Node) -> bool:
        """H6: twenty characters, and a business word, an address or a number."""
        start, end, _ = self.shown_span(node)
        if end - start < 20:
            return False
        if self._hits is None:
            found = [(m.start(), m.end(1)) for m in (_BUSINESS_AT if "@" in self.text else _BUSINESS_NO_MAIL_AT).finditer(self.text)]
            least = list(accumulate((e for _, e in reversed(found)), min))[::-1]  # the first end of those from here on
            self._hits = [s for s, _ in found], least
        starts, least = self._hits
        i = bisect_left(starts, start)
        if i < len(starts) and least[i] <= end:
            return True
        if _BUSINESS.match(self.text[start : min(end, start + _REACH)]):
            return True
        edge = max(start, end - _REACH), end  # elements that end together share it
        if edge not in self._edges:
            self._edges[edge] = _BUSINESS.search(self.text[slice(*edge)]) is not None
        return self._edges[edge]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at.tag in ENDS.get(tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def json_ld(html: str) -> list[str]:
    """Objects of the known types, once for each type and name."""
    found: dict[str, str] = {}

    def collect(value: object) -> None:
        if isinstance(value, list):
            for item in value:
                collect(item)
        elif isinstance(value, dict):
            kind = value.get("@type")
            if any(isinstance(k, str) and k in C.JSON_LD_TYPES for k in (kind if isinstance(kind, list) else [kind])):
                name = next((value[k] for k in ("name", "url") if value.get(k) is not None), "")
                found.setdefault(f"{kind}:{name}", json.dumps(value, ensure_ascii=False, separators=(",", ":")))
            if value.get("@graph"):
                collect(value["@graph"])

    for block in _JSON_LD.findall(html):
        try:
            collect(json.loads(block.strip()))
        except ValueError:
            continue
    return list(found.values())


def dropped(nodes: list[Node]) -> int:
    """Takes nodes out of their parents; how many."""
    gone = {id(n) for n in nodes}
    for parent in {id(n.parent): n.parent for n in nodes if n.parent is not None}.values():
        parent.children = [c for c in parent.children if id(c) not in gone]
    for node in nodes:
        node.parent = None
    return len(nodes)


def without_boilerplate(root: Node) -> int:
    """H2 to H5; the number of blocks removed (link lists don't count).

    A list of nodes is taken before a step removes any, and each node is judged
    by the text it has when its turn comes: as nodes come before those below
    them, that is the text at the start of the step.
    """
    every = root.every()
    tags, names = {n.tag for n in every}, {name for n in every for name in n.attrs}  # steps that can't find a node are left out
    removed = sum(dropped(root.every(tag)) for tag in C.REMOVABLE_TAGS if tag in tags)

    def sweep(nodes: list[Node], test: Callable[[Node], bool]) -> int:
        asked = [n for n in nodes if test(n)]
        tour = Tour(root) if asked else None
        return dropped([n for n in asked if not tour.is_protected(n)])

    def hidden(node: Node) -> bool:
        style = node.attrs.get("style", "").lower()
        return node.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style

    if names & {"style", "aria-hidden"}:
        removed += sweep(root.every(), hidden)
    for tag in C.BOILERPLATE_TAGS:
        if tag in tags:
            removed += sweep(root.every(tag), lambda node: True)
    if "role" in names:
        for role in C.BOILERPLATE_ROLES:
            removed += sweep(root.every(), lambda node, r=role: node.attrs.get("role") == r)
    if "aria-hidden" in names:
        removed += sweep(root.every(), lambda node: node.attrs.get("aria-hidden") == "true")
    if "form" in tags and "role" in names:
        removed += sweep(root.every("form"), lambda node: node.attrs.get("role") == "search")
    if names & {"id", "class"}:
        removed += sweep(root.every(), lambda node: any(t in node.marker() for t in C.BOILERPLATE_TOKENS) and not node.is_main())
    lists = root.every("ul", "ol")
    if lists:
        tour = Tour(root)
        links = lambda n: tour.below(n, "li") >= 4 and tour.below(n, "linked li") >= 0.8 * tour.below(n, "li")
        dropped([n for n in lists if links(n) and not tour.is_protected(n) and not n.is_main()])
    return removed


def score(node: Node, tour: Tour) -> int:
    """H8: how much a node looks like the page's content."""
    if not node.tag:
        return 0
    start, end, words = tour.shown_span(node)
    points = 100 * (node.tag == "main" or node.attrs.get("role") == "main") + 80 * (node.tag == "article")
    points += 30 * bool(tour.below(node, "h1")) + 20 * tour.is_protected(node)
    points += min(40, (end - start) // (tour.below(node) or 1)) - 20 * (end - start < 100)
    points -= 60 * any(t in node.marker() for t in C.LOW_SCORE_TOKENS)
    return points - 40 * bool(words and tour.below(node, "a") / words > 0.2)


def main_content(root: Node) -> Node:
    """H7: main, role=main, article, or the best of the candidates."""
    every = root.every()
    for test in (lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.tag == "article"):
        first = next((n for n in every if test(n)), None)
        if first is not None:
            return first
    best, most, tour = root, 0, Tour(root)
    for node in root.every("section", "article", "div"):
        if (points := score(node, tour)) > most:
            best, most = node, points
    return best


def headings(node: Node) -> list[tuple[int, str]]:
    found = [node] if node.tag in HEADINGS else []
    stack = [] if found else [c for c in reversed(node.children) if isinstance(c, Node)]
    while stack:
        at = stack.pop()
        if at.tag in HEADINGS:
            found.append(at)
        else:
            stack += [c for c in reversed(at.children) if isinstance(c, Node)]
    return [(int(h.tag[1]), h.text()) for h in found if h.text()]


def lines(node: Node) -> list[str]:
    """A line for each block, heading or stray text; blocks aren't entered."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(" ".join(at.split()))
        elif at.tag in HEADINGS:
            out.append(f"{'#' * int(at.tag[1])} {at.text()}" if at.text() else "")
        elif at.tag in C.BLOCK_TAGS:
            out.append(at.text())
        else:
            stack += reversed(at.children)
    return [x for x in out if x]


def attribute(root: Node, tag: str, test: tuple[str, str] | None, name: str) -> str | None:
    for node in root.every(tag):
        if test is None or node.attrs.get(test[0]) == test[1]:
            return node.attrs[name].strip() if name in node.attrs else None
    return None


def page_parts(html: str) -> dict:
    """The parts of a page that need its tree."""
    root = tree(html)
    removed = without_boilerplate(root)
    content = main_content(root)
    title = next((n.raw().strip() for n in root.every("title")), None)
    description = attribute(root, "meta", ("name", "description"), "content")
    if description is None:
        description = attribute(root, "meta", ("property", "og:description"), "content")
    language = attribute(root, "html", None, "lang")
    if language is None:
        language = attribute(root, "meta", ("http-equiv", "content-language"), "content")
    return {"title": title or None, "description": description, "language": language or None, "headings": headings(content),
            "json_ld": json_ld(html), "lines": lines(content), "blocks_removed": removed}
