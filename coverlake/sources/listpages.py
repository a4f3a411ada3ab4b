"""Pages that list articles, to rows: structured data first, then the extractor that the page's host has.

An extractor is data, one of three shapes: ``blocks`` (a selector for each item, and selectors within it), ``links`` (addresses by
pattern wherever they stand) and ``script`` (a JSON value in a script, and paths in it). The page is read into a small tree, on
which selectors match. The rows come from a Python table function joined to the pages, so pages stay where they are.

Edge cases: null or broken markup gives what can be read of it; the first item of each address is kept; an extractor that finds
nothing gives way to the next one of its host.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_in_url
from ..functions.text import loose_date, title_from_link

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in RAW or n is self:
                out.append(" " if n.tag in ("br", "p", "div", "li", "td") else "")
                stack.extend(reversed(n.children))
        return " ".join("".join(out).split())

    def below(self) -> Iterator[Node]:
        """All elements within, in page order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


class Tree(HTMLParser):
    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


STEP = re.compile(r"(>)?\s*([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w:-]+(?:[~^$*]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)\s*")
PART = re.compile(r"([.#])([\w-]+)|\[([\w:-]+)(?:([~^$*]?)=(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\]")


class Selector:
    """``tag.class#id[name=value]`` with descendants by space, children by ``>`` and alternatives by comma; of attributes ``=``,
    ``^=``, ``$=``, ``*=`` and ``~=``."""

    def __init__(self, text: str):
        self.ways = [self.steps(x.strip()) for x in text.split(",")]

    @staticmethod
    def steps(text: str) -> list[tuple[bool, str, list[tuple[str, str, str]]]]:
        out, at = [], 0
        while at < len(text):
            m = STEP.match(text, at)
            if m is None or m.end() == at or not (m[2] or m[3]):
                raise ValueError(f"selector {text!r}")
            tests = []
            for p in PART.finditer(m[3]):
                if p[1]:
                    tests.append(("class", "~", p[2]) if p[1] == "." else ("id", "", p[2]))
                else:
                    value = next((v for v in p.group(5, 6, 7) if v is not None), None)
                    tests.append((p[3], "has" if value is None else p[4] or "", value or ""))
            out.append((bool(m[1]), "" if m[2] in (None, "*") else m[2].lower(), tests))
            at = m.end()
        if not out:
            raise ValueError(f"selector {text!r}")
        return out

    @staticmethod
    def fits(n: Node, tag: str, tests: list[tuple[str, str, str]]) -> bool:
        if tag and n.tag != tag:
            return False
        for name, how, want in tests:
            have = n.attrs.get(name)
            if have is None:
                return False
            ok = {
                "has": True, "": have == want, "~": want in have.split(), "^": have.startswith(want), "$": have.endswith(want),
                "*": want in have
            }[how]
            if not ok:
                return False
        return True

    def matches(self, n: Node, top: Node) -> bool:
        """Does n, somewhere below top, match?"""

        def way(n: Node, steps: list) -> bool:
            child, tag, tests = steps[-1]
            if not self.fits(n, tag, tests):
                return False
            if len(steps) == 1:
                return not child or n.parent is top
            up = n.parent
            while up is not None and up is not top:
                if way(up, steps[:-1]):
                    return True
                if child:
                    return False
                up = up.parent
            return False

        return any(way(n, steps) for steps in self.ways)

    def all(self, top: Node) -> Iterator[Node]:
        return (n for n in top.below() if self.matches(n, top))

    def first(self, top: Node) -> Node | None:
        return next(self.all(top), None)


def value(top: Node, spec: str) -> str:
    """``selector@attribute`` or ``selector`` (its text); without a selector of the element itself."""
    selector, _, attribute = spec.partition("@")
    n = Selector(selector).first(top) if selector.strip() else top
    if n is None:
        return ""
    return n.attrs.get(attribute, "").strip() if attribute else n.text()


def at_path(tree: Any, path: str) -> Any:
    """``a.b.0.c`` in a JSON value; null where it ends."""
    for key in filter(None, path.split(".")):
        if isinstance(tree, dict):
            tree = tree.get(key)
        elif isinstance(tree, list) and key.isdigit() and int(key) < len(tree):
            tree = tree[int(key)]
        else:
            return None
    return tree


def worded(v: Any) -> str:
    return " ".join(v.split()) if isinstance(v, str) else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else ""


Item = tuple[str, str, str]


def from_blocks(tree: Node, spec: dict) -> Iterator[Item]:
    for n in Selector(spec["item"]).all(tree):
        yield value(n, spec["link"]), value(n, spec["title"]), value(n, spec["date"]) if spec.get("date") else ""


def from_links(tree: Node, spec: dict) -> Iterator[Item]:
    pattern = re.compile(spec["pattern"])
    within = Selector(spec["within"]).all(tree) if spec.get("within") else [tree]
    for top in within:
        for n in top.below():
            if n.tag == "a" and (m := pattern.search(n.attrs.get("href", ""))):
                yield n.attrs["href"].strip(), n.attrs.get("title", "").strip() or n.text(), m.groupdict().get("date") or ""


def from_script(tree: Node, spec: dict) -> Iterator[Item]:
    begins = re.compile(spec["begins"])
    for n in Selector("script").all(tree):
        text = "".join(c for c in n.children if isinstance(c, str))
        if m := begins.search(text):
            try:
                found, _ = json.JSONDecoder().raw_decode(text[m.end() :].lstrip())
            except ValueError:
                continue
            for entry in at_path(found, spec.get("items", "")) or []:
                yield spec.get("prefix", "") + worded(at_path(entry, spec["link"])), worded(at_path(entry, spec["title"])), worded(
                    at_path(entry, spec.get("date", "")) if spec.get("date") else ""
                )


SHAPES = {"blocks": from_blocks, "links": from_links, "script": from_script}

# Names under which structured data holds lists, and what an entry tells.
LISTS, NESTED = ("collectionpage", "itemlist"), ("mainEntity", "item", "hasPart")
LINK, TITLE, DATE = ("url", "@id", "mainEntityOfPage"), ("name", "headline", "title"), ("datePublished", "dateCreated", "dateModified")


def told(entry: Any, names: tuple[str, ...]) -> str:
    while isinstance(entry, dict):
        for name in names:
            if found := worded(entry.get(name)):
                return found
        entry = entry.get("item")
    return ""


def from_data(tree: Node) -> Iterator[Item]:
    """The entries of all item lists in the page's JSON-LD."""
    for n in Selector("script[type='application/ld+json']").all(tree):
        text = "".join(c for c in n.children if isinstance(c, str))
        try:
            stack = [json.loads(text, strict=False)]
        except ValueError:
            continue
        while stack:
            x = stack.pop()
            if isinstance(x, list):
                stack.extend(reversed(x))
            elif isinstance(x, dict):
                kinds = x.get("@type")
                kinds = [k.strip().lower() for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
                entries = x.get("itemListElement")
                if any(k in LISTS for k in kinds) and isinstance(entries, list):
                    for e in entries:
                        if isinstance(e, dict):
                            yield told(e, LINK), told(e, TITLE), told(e, DATE)
                stack.extend(x[k] for k in reversed((*NESTED, "@graph")) if k in x)


def bare_host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def items(html: str | None, url: str | None, extractors: list[dict]) -> list[tuple[str, str, str, str]]:
    """(extractor, link, title, date) of the first extractor that finds any: structured data, then those of the host in order."""
    tree = Tree(html).root
    name = bare_host(url)
    tries = [("data", lambda: from_data(tree))]
    for spec in extractors:
        if spec["host"] == "*" or name == spec["host"] or name.endswith("." + spec["host"]):
            tries.append((spec["name"], lambda spec=spec: SHAPES[spec["shape"]](tree, spec)))
    for label, found in tries:
        seen, out = set(), []
        for link, title, date in found():
            try:
                whole = urljoin(url or "", link) if link else ""
            except ValueError:
                whole = link
            key = whole or f"{title}|{date}"
            if key != "|" and key not in seen:
                seen.add(key)
                out.append((label, whole, title, date))
        if out:
            return out
    return []


def list_items(pages: DataFrame, extractors: list[dict], limit: int = 12) -> DataFrame:
    """pages: html, url and any other columns but these. Those other than html, then extractor, rank (from 1), link, title, date
    (timestamp) of the first ``limit`` items. extractors: name, host (``*``: any), shape and what the shape needs; a bounded table."""
    from pyspark.sql.functions import udtf

    table = [dict(x) for x in extractors]
    for spec in table:  # mistakes are told before any page is read
        assert spec["shape"] in SHAPES, spec
        for name in ("item", "within"):
            if spec.get(name):
                Selector(spec[name])

    @udtf(returnType="extractor: string, rank: int, link: string, title: string, _date: string")
    class Listed:
        def eval(self, html: str, url: str):
            for k, row in enumerate(items(html, url, table)[:limit]):
                yield row[0], k + 1, *row[1:]

    rest = [c for c in pages.columns if c != "html"]
    rows = pages.lateralJoin(Listed(F.col("html").outer(), F.col("url").outer())).select(
        *rest, "extractor", "rank", "link", "title", "_date"
    )
    date = F.coalesce(loose_date(F.nullif("_date", F.lit(""))), date_in_url(F.col("link")).cast("timestamp"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif(title_from_link("link"), F.lit("")), F.col("link"))
    return rows.select(*rest, "extractor", "rank", F.nullif("link", F.lit("")).alias("link"), title.alias("title"), date.alias("date"))


__all__ = ["Selector", "Tree", "items", "list_items"]
