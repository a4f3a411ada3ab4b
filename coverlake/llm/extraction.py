"""HTML main-text extraction by minimum-cut labelling.

A page is read into blocks of text in page order. Each block is a node: its cost of being boilerplate is a capacity from
the source, its cost of being content a capacity to the sink. Neighbouring blocks and blocks under one parent are joined
by smoothness edges. The maximum flow's cut separates content from boilerplate at least cost.

The costs are log odds of shape features (length, share of link text, punctuation, tag), learned by counting over pages whose
markup names its parts (article and main against nav, footer, aside and the like), plus fixed evidence from such names where
a page has them. Shape counts up to a bound below the evidence of a name, whatever the pages learned from look like: it decides
where nothing is named, and where a page has an article of some length, what stands outside is taken for boilerplate first. A
name in class, id or role ends where an article or main begins; words that only tell a layout (has-sidebar), or header within
an article, are no names, nor is the name of a layout on an element that holds all of a page.

Scale: a map over batches without shuffle. Learning reads at most ``fit_pages`` pages and returns one count per feature, of
which there are a fixed number.

Edge cases: null or empty html gives the empty text; broken markup is read as far as it goes, an unfinished tag at the end is
dropped; text of any length is kept whole; repeated rows and null ids are treated row by row; an empty table gives an empty
table; input columns named ``text`` or ``n_chars`` give way to the results. A block whose labels cost the same is boilerplate.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unpacked

SKIPPED = {"script", "style", "head", "noscript", "template", "svg", "iframe", "object", "select", "button", "textarea", "canvas", "math"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
BLOCKS = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td",
    "th", "caption", "section", "article", "header", "main", "blockquote", "pre", "figure", "figcaption", "address", "hr", "body", "html",
    "details", "summary", "center", "legend", "option", "title"
} | BOILERPLATE
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id or role that name boilerplate.
NAMED = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed)?|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|navs?|navbars?|navigation|menus?|breadcrumbs?|footers?|headers?|masthead|topbar|comments?|commentlist|disqus|repl(?:y|ies)|respond|related|recommend(?:ed|ations)?|shar(?:e|ing)|social|newsletters?|subscribe|signup|login|popups?|modals?|overlay|widgets?|pagination|pager|toolbar|skip|search|complementary|contentinfo)(?:$|[^a-z])"
)
#: Words that tell what a part has or has not, not what it is, and those that are content's own within an article.
LAYOUT = re.compile(
    r"(?:(?<!\S)|(?<=[-_]))(?:has|have|with|without|no|not|hide|hides|show|shows)[-_]\S*|\S*[-_](?:open|opened|closed|enabled|disabled|on|off|active|inactive)(?!\S)"
)
OWN = re.compile(r"(?<![a-z])headers?(?![a-z])")
#: What a paragraph or heading of an article may be called and yet be its own, and what may name a whole page for its layout.
MILD = re.compile(
    r"(?:^|[^a-z])(?:headers?|banners?|notices?|alerts?|related|recommend(?:ed|ations)?|navs?|navigation|footers?|masthead|topbar|widgets?|modals?|overlay|search|skip|shar(?:e|ing)|social|repl(?:y|ies)|respond)(?=$|[^a-z])"
)
FRAME = re.compile(
    r"(?:^|[^a-z])(?:headers?|banners?|sidebars?|navs?|navbars?|navigation|menus?|footers?|topbar|toolbar|widgets?|overlay|modals?|social|search|skip)(?=$|[^a-z])"
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACE = re.compile(r"\s+")
UNFINISHED = re.compile(r"</?[A-Za-z!]")

#: OWN_CLASSED is for a paragraph or heading of an article that itself has a mild name. OUTSIDE is for what stands outside where
#: an article has over ARTICLE_WORDS words. SHAPE is the most that shape counts: with the edges it stays below IN_CLASSED.
IN_NAMED, IN_CLASSED, OWN_CLASSED, IN_ARTICLE, HEADING, OUTSIDE, SHAPE, ARTICLE_WORDS = 14.0, 8.0, 2.0, 6.0, 3.0, 6.0, 4.0, 40
ADJACENT, SIBLING = 0.8, 0.4
#: Log odds of content for each shape feature before any page has been counted.
PRIOR = {
    "length:0": -0.8, "length:1": -0.2, "length:2": 0.6, "length:3": 1.2, "links:0": 0.6, "links:1": -0.6, "links:2": -2.0, "stops:0": -0.5,
    "stops:1": 0.4, "tag:p": 0.8, "tag:h": 0.8, "tag:li": -0.5, "tag:div": -0.3, "tag:other": -0.1
}


class Reader(HTMLParser):
    """Blocks of (text, evidence, tag, parent, characters in links, element whose class names it or 0, is it in an article).
    The names of the elements in ``unnamed`` do not count."""

    def __init__(self, unnamed: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        # tag, is it left out, how far it is named boilerplate (0 or a cost), is it in an article, its number, then of the
        # innermost block around (itself, if it is one): its place in the stack, and the number of what that is in; then the
        # element whose class names it
        self.stack: list[tuple[str, bool, float, bool, int, int, int, int]] = [("", False, 0.0, False, 0, 0, 0, 0)]
        self.unnamed, self.frames = unnamed, set()
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[tuple[str, float, str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.linked = self.made = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, _, named, article, _, block, parent, root = self.stack[-1]
            tag = self.stack[block][0]
            evidence = -named if named else IN_ARTICLE if article else 0.0
            if len(tag) == 2 and tag[0] == "h" and article and not named:
                evidence += HEADING
            self.blocks.append((text, evidence, tag, parent, self.linked, root, article))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag in BLOCKS and self.stack[-1][0] == "p":
                self.close_open("p" if tag not in ("li", "dt", "dd", "tr", "td", "th", "option") else tag)
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, out, named, article, inside, block, parent, root = self.stack[-1]
        words = " ".join(v.lower() for k, v in attrs if v and k in ("class", "id", "role"))
        hidden = any(
            k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and HIDDEN.search(v.lower()) for k, v in attrs
        )
        begins = tag in ("article", "main")
        self.made += 1
        if begins and named < IN_NAMED:
            named, root = 0.0, 0
        if tag in BOILERPLATE or tag == "header" and not article:
            named, root = IN_NAMED, 0
        elif words and not named and tag not in ("body", "html", "article", "main") and self.made not in self.unnamed:
            words = LAYOUT.sub("", words)
            words = OWN.sub("", words) if article else words
            if NAMED.search(words):
                own = article and (tag == "p" or len(tag) == 2 and tag[0] == "h") and not NAMED.search(MILD.sub(" ", words))
                named, root = OWN_CLASSED if own else IN_CLASSED, self.made
                if not NAMED.search(FRAME.sub(" ", words)):
                    self.frames.add(root)
        if tag in BLOCKS:
            block, parent = len(self.stack), inside
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, out or hidden or tag in SKIPPED, named, article or begins, self.made, block, parent, root))

    def close_open(self, tag: str) -> None:
        """End an open element of this kind, unless a larger one was begun in it."""
        block = self.stack[-1][5]
        if self.stack[block][0] == tag:
            self.cut(block)

    def cut(self, k: int) -> None:
        for x in reversed(self.stack[k:]):
            self.open[x[0]].pop()
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        places = self.open.get(tag)
        # an inline end tag closes nothing beyond its block
        if places and (tag in BLOCKS or places[-1] > self.stack[-1][5]):
            self.cut(places[-1])

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.parts.append(data)
            if self.open.get("a"):
                self.linked += len(data)


def read(html: str | None) -> list[tuple[str, float, str, int, int, int, bool]]:
    text = html or ""
    # an unfinished tag or comment at the end goes with all after it
    last = text.rfind(">") + 1
    if m := UNFINISHED.search(text, last):
        text = text[: m.start()]
    if (at := text.rfind("<!--")) >= 0 and "-->" not in text[at:] and "--!>" not in text[at:]:
        text = text[: text.index("<!--", max(text.rfind("-->", 0, at), text.rfind("--!>", 0, at), 0))]
    unnamed: frozenset[int] = frozenset()
    while True:
        r = Reader(unnamed)
        r.feed(text)
        r.close()
        r.flush()
        roots = {b[5] for b in r.blocks}
        if len(roots) != 1 or not roots <= r.frames or len(unnamed) > 8:
            return r.blocks
        unnamed |= roots  # all of the page lies in one element with the name of a layout


def shape(block: tuple) -> tuple[str, str, str, str]:
    text, _, tag, _, linked, _, _ = block
    words = text.count(" ") + 1
    share = linked / max(len(text), 1)
    kind = tag if tag in ("p", "li", "div") else "h" if len(tag) == 2 and tag[0] == "h" else "other"
    return f"length:{(words > 3) + (words > 12) + (words > 40)}", f"links:{(share > 0.2) + (share > 0.6)}", f"stops:{int(text[-1] in '.!?:;…。')}", f"tag:{kind}"


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Label each node: True (content) costs max(-gain, 0), False costs max(gain, 0), a cut edge its weight; least sum.

    Maximum flow by shortest augmenting levels; nodes that the source still reaches are content.
    """
    n = len(gain)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, g in enumerate(gain):
        if g > 0:
            edge(s, i, g, 0.0)
        elif g < 0:
            edge(i, t, -g, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                first = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= 1e-9 and not first:
                        first = k + 1
                a = to[path[first - 1] ^ 1]
                del path[first - 1 :]
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def label(blocks: list[tuple], costs: dict[str, float]) -> list[bool]:
    inside = sum(b[0].count(" ") + 1 for b in blocks if b[6] and b[1] > 0)
    outside = OUTSIDE if inside > ARTICLE_WORDS else 0.0
    gain = [b[1] - (0.0 if b[6] or b[1] else outside) + max(-SHAPE, min(SHAPE, sum(costs.get(f, 0.0) for f in shape(b)))) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if (j := last.get(b[3])) is not None:
            edges.append((j, i, SIBLING))
        last[b[3]] = i
    return min_cut(gain, edges)


def main_text(html: str | None, costs: dict[str, float]) -> str:
    blocks = read(html)
    return " ".join(b[0] for b, keep in zip(blocks, label(blocks, costs), strict=True) if keep)


def fit(pages: DataFrame, html: str = "html", fit_pages: int = 2_000, prior_weight: float = 20.0) -> dict[str, float]:
    """Log odds of content for each shape feature, from the fit_pages pages with the least digests (and rows equal to these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], int] = {}
        for b in batches:
            for h in b.column(0):
                for block in read(h.as_py()):
                    if abs(block[1]) >= IN_ARTICLE:
                        for f in shape(block):
                            seen[f, block[1] > 0] = seen.get((f, block[1] > 0), 0) + 1
        yield pa.RecordBatch.from_pydict(
            {
                "feature": pa.array([f for f, _ in seen], pa.string()), "content": pa.array([c for _, c in seen], pa.bool_()),
                "n": pa.array(list(seen.values()), pa.int64())
            }
        )

    # digests alone find the bound, so that no page moves; rows that are equal throughout share theirs
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns])
    bound = pages.select(digest.alias("d")).orderBy("d").limit(fit_pages).agg(F.max("d")).first()[0]
    some = pages.filter(digest <= bound).select(F.col(html).alias("_html")) if bound is not None else pages.limit(0).select(F.col(html).alias("_html"))
    counts = some.mapInArrow(  # at most two rows a feature
        run, "feature string, content boolean, n long"
    ).groupBy("feature", "content").agg(F.sum("n").alias("n")).collect()
    n = {(r["feature"], r["content"]): r["n"] for r in counts}
    groups = {
        g: [sum(n.get((f, c), 0) for f in PRIOR if f.startswith(g)) for c in (False, True)] for g in ("length:", "links:", "stops:", "tag:")
    }
    out = {}
    for f, prior in PRIOR.items():
        bad_all, good_all = groups[f.split(":")[0] + ":"]
        bad, good = n.get((f, False), 0), n.get((f, True), 0)
        seen = log((good + 0.5) / (good_all + 1)) - log((bad + 0.5) / (bad_all + 1))
        weight = (good + bad) / (good + bad + prior_weight)
        out[f] = max(-2.0, min(2.0, weight * seen + (1 - weight) * prior))
    return out


def extract(pages: DataFrame, costs: dict[str, float], html: str = "html") -> DataFrame:
    """All columns of pages but for the html, then text and n_chars (code points)."""
    columns = [c for c in pages.columns if c != html]
    rows = pages.select(F.struct(*[pages[f"`{c}`"] for c in columns]).alias("_row"), F.col(html).alias("_html"))
    schema = rows.select("_row", F.lit("").alias("_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([main_text(h.as_py(), costs) for h in part.column(1)], pa.string())], names=["_row", "_text"]
                )

    return unpacked(rows.mapInArrow(run, schema), columns, {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")})
