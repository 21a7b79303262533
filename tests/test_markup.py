"""Cleaning of page trees: against a version that reads whole texts at each
step, and in time that grows with the page."""

from __future__ import annotations

import random
import time

from prospectrum import constants as C
from prospectrum.functions import markup


def drop(node):
    if node.parent is not None:
        node.parent.children = [c for c in node.parent.children if c is not node]
        node.parent = None


def protected(node):
    text = node.text()
    return len(text) >= 20 and markup._BUSINESS.search(text) is not None


def plain_cleaning(root) -> int:
    """Each node is judged by its text at its turn, read from the tree."""
    removed = 0
    for tag in C.REMOVABLE_TAGS:
        for node in root.every(tag):
            drop(node)
            removed += 1

    def sweep(nodes, test):
        n = 0
        for node in nodes:
            if test(node) and not protected(node):
                drop(node)
                n += 1
        return n

    def hidden(node):
        style = node.attrs.get("style", "").lower()
        return node.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style

    removed += sweep(root.every(), hidden)
    for tag in C.BOILERPLATE_TAGS:
        removed += sweep(root.every(tag), lambda node: True)
    for role in C.BOILERPLATE_ROLES:
        removed += sweep(root.every(), lambda node, r=role: node.attrs.get("role") == r)
    removed += sweep(root.every(), lambda node: node.attrs.get("aria-hidden") == "true")
    removed += sweep(root.every("form"), lambda node: node.attrs.get("role") == "search")
    removed += sweep(root.every(), lambda node: any(t in node.marker() for t in C.BOILERPLATE_TOKENS) and not node.is_main())
    for links in root.every("ul", "ol"):
        items = links.every("li")
        linked = sum(bool(item.every("a")) for item in items)
        if len(items) >= 4 and linked >= 0.8 * len(items) and not protected(links) and not links.is_main():
            drop(links)
    return removed


def plain_score(node) -> int:
    text = node.text()
    points = 100 * (node.tag == "main" or node.attrs.get("role") == "main") + 80 * (node.tag == "article")
    points += 30 * bool(node.every("h1")) + 20 * protected(node)
    points += min(40, len(text) // (len(node.every()) or 1)) - 20 * (len(text) < 100)
    points -= 60 * any(t in node.marker() for t in C.LOW_SCORE_TOKENS)
    return points - 40 * bool(text and len(node.every("a")) / max(len(text.split(" ")), 1) > 0.2)


def page(rng: random.Random, size: int) -> str:
    """A random page with all that the steps look for, some of it never closed."""
    words = ["about", "contact", "us", "our", "team", "x", "customers", "mail", "jane@acme.fi", "+358 40 123 4567", "lorem ", " ipsum", "\n", "serv", "ices", "pro", "ducts", "&amp;", "a@", "b.fi", "company"]
    marks = ['class="cookie-banner"', 'class="nav"', 'id="sidebar"', 'class="social share"', 'aria-hidden="true"', 'style="display:none"', 'role="navigation"', 'role="main"', 'role="search"', 'class="hero"', "", "", ""]
    out, open_ = [], []
    for _ in range(size):
        kind = rng.random()
        if kind < 0.45:
            out.append(rng.choice(words) + rng.choice(["", " "]))
        elif kind < 0.8 or not open_:
            tag = rng.choice(["div", "div", "section", "ul", "ol", "li", "li", "a", "p", "span", "h1", "h2", "nav", "footer", "form", "b", "aside", "script", "table", "td"])
            out.append(f"<{tag} {rng.choice(marks)}>")
            open_.append(tag)
        else:
            out.append(f"</{open_.pop(rng.choice([-1, -1, -1, 0]))}>")
    return "".join(out)


def test_cleaning_equals_the_plain_version_on_random_pages():
    rng, protected_ones = random.Random(21), 0
    for i in range(600):
        html = page(rng, rng.choice([20, 80, 300]))
        one, two = markup.tree(html), markup.tree(html)
        tour = markup.Tour(one)
        for node in one.every():
            start, end, words = tour.shown_span(node)
            assert tour.text[start:end] == node.text() and words == len(node.text().split()), i
            assert tour.is_protected(node) == protected(node), (i, node.text())
            assert markup.score(node, tour) == plain_score(node)
            protected_ones += protected(node)
        assert markup.without_boilerplate(one) == plain_cleaning(two), i
        assert [n.tag for n in one.every()] == [n.tag for n in two.every()] and one.raw() == two.raw()
    assert protected_ones > 1000


def test_time_grows_with_the_page():
    """Nested, wide and list pages of 20,000 elements."""
    deep = "".join(f'<div class="sidebar">own text {i} ' for i in range(20_000))
    wide = "<div>" + '<span class="cookie">we use them</span>' * 20_000 + "</div>"
    lists = "<ul><li><a>x</a>" * 7_000
    for html in (deep, wide, lists):
        root = markup.tree(html)
        began = time.perf_counter()
        markup.without_boilerplate(root)
        markup.main_content(root)
        assert time.perf_counter() - began < 4  # some tenths; by texts at each node minutes
