"""Main text of web pages by minimum-cut labelling (operator 5).

A page is a row of text blocks.  A linear classifier gives each block the cost
of either label, content or boilerplate, as capacities to the two terminals.
Blocks that follow each other and blocks under one parent are joined by
smoothness edges, the stronger the nearer they are in the tree.  The maximum
flow from one terminal to the other separates the page at the least total cost:
a heading or a short paragraph between long ones stays, a long line between
links goes.

The classifier is fitted on pages that mark their main part with article or main,
with those marks withheld: each block is counted under what is seen of it, and
the counts fit the weights around the prior ones.  Where a page has the marks,
they add to the costs.

Pages are independent, so this is one narrow pass over them.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import exact

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<(?:/?[a-zA-Z]|[!?])[^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video xmp noembed noframes".split())
CONTROLS = frozenset("button select datalist option optgroup output progress meter".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img button input select datalist option optgroup output progress meter".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ASIDE = frozenset("nav footer aside form menu dialog fieldset search".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form tablist toolbar".split())
# Words in class and id.
BAD = re.compile(r"(?:^|[^a-z])(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|comments?|disqus|replies|reply|respond|sidebar|side-bar|menus?|nav\w*|breadcrumbs?|footer|foot|header|masthead|toolbar|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|sign-up|login|popup|modal|overlay|widget|pagination|pager|copyright|legal|disclaimer|skip|search\w*|form|discussions?|reactions?|feedback)(?![a-z])")
GOOD = re.compile(r"(?:^|[^a-z])(content|article\w*|post|entry|story|main|body|text)(?![a-z])")
# Words of lines that say who holds rights, and of notices that ask for consent.
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
CONSENT = re.compile(r"\bcookies?\b.*\b(?:accept|agree|consent|settings|preferences|policy)\b|\b(?:accept|agree|consent|we use|uses)\b.*\bcookies?\b", re.I | re.S)
#: What is seen of a block, with the prior weight of each; MARKED is what article and main add, and never fitted.
PRIOR = {"bias": -0.4, "p": 0.9, "heading": 0.5, "item": -0.4, "aside": -12.0, "bad name": -9.0, "good name": 2.0, "some links": -1.0, "most links": -4.0, "1-3 words": -0.8, "4-8 words": -0.2, "20-49 words": 1.0, "50 words": 2.5, "sentence": 0.5, "rights": -6.0, "consent": -6.0}
MARKED = 4.0
#: Strength of the smoothness edges between siblings; each step more in the tree halves it.
SMOOTH, FAR = 1.5, 64
#: Pages that the classifier is fitted on, about; how far the weights may go from the prior, and what all counts weigh together.
SAMPLE, SPREAD, WEIGHT = 2000, 0.5, 200.0


@dataclass
class Element:
    """What an element is: aside, bad, good, main or nothing; block is the nearest one around it, itself included, that is not inline, depth how many of those there are."""

    name: str
    above: Element | None
    kind: str
    hidden: bool
    link: bool
    control: bool
    in_main: bool
    in_bad: bool
    depth: int
    block: Element | None = None
    kinds: frozenset[str] = frozenset()
    words: int = 0


@dataclass
class Block:
    text: str
    element: Element | None
    words: int
    linked: int

    def kinds(self) -> frozenset[str]:
        """Kinds of the elements around it."""
        return self.element.kinds if self.element else frozenset()

    def seen(self) -> tuple[str, ...]:
        """What the classifier knows of it, without the marks of the main part."""
        kinds, out = self.kinds(), ["bias"]
        name = self.element.block.name if self.element and self.element.block else ""
        out += ["p"] if name == "p" else ["heading"] if name in HEADINGS else ["item"] if name in ("li", "td", "th", "dt", "dd") else []
        if "aside" in kinds:
            out.append("aside")
        elif "bad" in kinds:
            out.append("bad name")
        elif "good" in kinds:
            out.append("good name")
        if self.linked:
            out.append("most links" if 2 * self.linked >= self.words else "some links")
        n = self.words
        out += ["1-3 words"] if n < 4 else ["4-8 words"] if n < 9 else [] if n < 20 else ["20-49 words"] if n < 50 else ["50 words"]
        if self.text[-1] in ".!?…。\"”»":
            out.append("sentence")
        if n < 50 and "main" not in kinds:  # an article may speak of both
            out += ["rights"] if RIGHTS.match(self.text) else ["consent"] if CONSENT.search(self.text) else []
        return tuple(out)


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    mains: set[bool] = field(default_factory=set)
    elements: list[Element] = field(default_factory=list)
    open: Counter[str] = field(default_factory=Counter)


def _element(page: Page, name: str, attributes: str) -> Element:
    above = page.stack[-1] if page.stack else None
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    role = found.get("role", "")
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".strip() if name not in ("html", "body") else ""
    kind = ""
    if name in ASIDE or role in ROLES or name == "header" and not (above and above.in_main):
        kind = "aside"
    elif names and BAD.search(names) and not (name in MAIN and GOOD.search(names)):
        kind = "bad"
    elif name in MAIN or role in ("main", "article"):
        kind = "main"
    elif names and GOOD.search(names):
        kind = "good"
    hidden = name in ("head", "title") or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if kind == "main":
        page.mains.add(bool(above and above.in_bad))
    inline = name in INLINE
    e = Element(name, above, kind, hidden or bool(above and above.hidden), name == "a" or bool(above and above.link), name in CONTROLS or bool(above and above.control), kind == "main" or bool(above and above.in_main), kind == "bad" or bool(above and above.in_bad), (above.depth if above else 0) + (not inline))
    e.block = above.block if inline and above else None if inline else e
    page.elements.append(e)
    return e


def _flush(page: Page) -> None:
    text = " ".join(html.unescape("".join(t for t, _ in page.parts)).split())
    if text:
        top = page.stack[-1] if page.stack else None
        if not (top and top.hidden):
            linked = len(html.unescape("".join(t if link else " " for t, link in page.parts)).split())
            page.blocks.append(Block(text, top, len(text.split()), linked))
    page.parts.clear()


def _pop(page: Page, size: int) -> None:
    if any(e.name not in INLINE for e in page.stack[size:]):
        _flush(page)
    page.open.subtract(e.name for e in page.stack[size:])
    del page.stack[size:]


def _close(page: Page, names, border=frozenset()) -> None:
    """Ends the innermost open element of the names, unless one of border is nearer."""
    if not any(page.open[n] for n in names):
        return
    for i in range(len(page.stack) - 1, -1, -1):
        if page.stack[i].name in names:
            _pop(page, i)
            return
        if page.stack[i].name in border:
            return


def blocks_of(source: str) -> list[Block]:
    """The text blocks of a page, in page order, without what form controls hold."""
    page, at = Page(), 0
    while True:
        m = TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        top = page.stack[-1] if page.stack else None
        if text and not (top and top.control):
            page.parts.append((text, bool(top and top.link)))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "p" and not page.open["p"]:
                _flush(page)
            elif name not in VOID:
                _close(page, {name}, frozenset() if name not in INLINE else CLOSES_P)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?![a-z0-9])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in CLOSES_P:
            _close(page, {"p"}, frozenset(("button", "table", "td", "th")))
        if name in SAME:
            _close(page, SAME[name], HOLDS[name])
        if name == "body":
            _close(page, {"head"})
        if name not in INLINE:
            _flush(page)
        elif name in CONTROLS:
            page.parts.append((" ", False))
        if name not in VOID:
            page.stack.append(_element(page, name, m[3] or m[6] or ""))
            page.open[name] += 1
    _flush(page)
    _settle(page)
    return page.blocks


def _settle(page: Page) -> None:
    """Gives each element the kinds around it, from the outermost on.

    A form that holds most of a page's words is how the page is built, and so
    are bad names around all main parts.
    """
    for b in page.blocks:
        if b.element:
            b.element.words += b.words
    for e in reversed(page.elements):
        if e.above:
            e.above.words += e.words
    layout, whole = page.mains == {True}, sum(b.words for b in page.blocks)
    for e in page.elements:
        if e.name == "form" and e.kind == "aside" and 2 * e.words > whole:
            e.kind = ""
        around = e.above.kinds if e.above else frozenset()
        if e.kind == "main" and layout:
            around = around - {"bad"}
        e.kinds = around | {e.kind} if e.kind else around


def leanings(blocks: list[Block], weights: dict[str, float]) -> list[float]:
    """For each block what calling it boilerplate costs over what calling it content costs."""
    out = []
    for b in blocks:
        kinds = b.kinds()
        out.append(sum(map(weights.__getitem__, b.seen())) + (MARKED if "main" in kinds and not kinds & {"aside", "bad"} else 0.0))
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours, and from each block to the next one under its parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        near = {i - 1} if i else set()
        own = b.element.block if b.element else None
        parent = id(_parent(own)) if own else 0
        if parent in last:
            near.add(last[parent])
        last[parent] = i
        for j in near:
            out.append((j, i, SMOOTH * 0.5 ** (_steps(own, blocks[j].element.block if blocks[j].element else None) - 2)))
    return out


def _parent(e: Element) -> Element | None:
    """The block element right around one."""
    return e.above.block if e.above else None


def _steps(a: Element | None, b: Element | None) -> int:
    """Steps from one block element to another along the tree; where that is far, so many that an edge is next to nothing."""
    n = 0
    while a is not b and n < FAR:
        if b is None or a is not None and a.depth >= b.depth:
            a = _parent(a)
        else:
            b = _parent(b)
        n += 1
    return n


def minimum_cut(leanings: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, by maximum flow in phases: in each, all shortest paths are filled.

    A positive leaning is capacity from the source, a negative one to the sink.
    """
    left, least = list(leanings), 1e-9
    room: list[dict[int, float]] = [{} for _ in left]
    for i, j, w in edges:
        room[i][j] = room[i].get(j, 0.0) + w
        room[j][i] = room[j].get(i, 0.0) + w
    while True:
        depth = {i: 0 for i, x in enumerate(left) if x > least}
        queue, goal = deque(depth), None
        while queue:
            i = queue.popleft()
            if goal is not None and depth[i] >= goal:
                continue
            for j, r in room[i].items():
                if r > least and j not in depth:
                    depth[j] = depth[i] + 1
                    if left[j] < -least and goal is None:
                        goal = depth[j]
                    queue.append(j)
        if goal is None:
            return [i in depth for i in range(len(left))]
        ways = {i: iter(list(room[i])) for i in depth}
        for start in [i for i, d in depth.items() if d == 0]:
            path = [start]
            while path and left[start] > least:
                i = path[-1]
                if left[i] < -least:
                    flow = min([left[start], -left[i], *(room[a][b] for a, b in zip(path, path[1:]))])
                    left[start] -= flow
                    left[i] += flow
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] = room[b].get(a, 0.0) + flow
                    ways.update((i, iter(list(room[i]))) for i in path)
                    path = [start]
                    continue
                for j in ways[i]:
                    if depth.get(j) == depth[i] + 1 and room[i][j] > least:
                        path.append(j)
                        break
                else:
                    path.pop()


def main_text(source: str, weights: dict[str, float] = PRIOR) -> tuple[str, int, int, int]:
    """Main text, number of blocks, of kept ones, and of those whose label the cut has turned."""
    blocks = blocks_of(source)
    lean = leanings(blocks, weights)
    keep = minimum_cut(lean, edges_of(blocks))
    kept = [b.text for b, k in zip(blocks, keep) if k]
    return " ".join(kept), len(blocks), len(kept), sum((x > 0) != k for x, k in zip(lean, keep))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is seen of the blocks of pages that mark their main part, with its label."""
    for batch in W.slices(batches, "html"):
        seen, label = [], []
        for source in batch.column("html").to_pylist():
            blocks = blocks_of(source)
            kinds = [b.kinds() for b in blocks]
            if any("main" in k for k in kinds):
                seen += ["|".join(b.seen()) for b in blocks]
                label += ["main" in k and not k & {"aside", "bad"} for k in kinds]
        yield pa.record_batch([pa.array(seen, pa.string()), pa.array(label, pa.bool_())], names=["seen", "label"])


def fit(pages: DataFrame, source: str = "html", page_id: str = "page_id", sample: int = SAMPLE) -> dict[str, float]:
    """Weights fitted on about `sample` pages, those of least hashed ids.

    Logistic regression on the counts of what is seen of the blocks, with a
    normal prior around PRIOR; the counts together weigh as WEIGHT blocks, so
    what the sample lacks keeps its prior weight.  Without marked pages PRIOR
    comes back.
    """
    share = min(1.0, sample / max(1, pages.count()))
    some = pages.where(F.pmod(F.xxhash64(page_id), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.coalesce(F.col(source), F.lit("")).alias("html"))
    rows = some.mapInArrow(_counted, "seen string, label boolean").groupBy("seen", "label").count().toArrow().to_pylist()
    names = list(PRIOR)
    x = np.array([[float(c in r["seen"].split("|")) for c in names] for r in rows]).reshape(-1, len(names))
    y, n = np.array([float(r["label"]) for r in rows]), np.array([float(r["count"]) for r in rows])
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    if len(rows):
        n *= min(1.0, WEIGHT / n.sum())
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (y - p)) - (w - prior) / SPREAD**2
            w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / SPREAD**2, slope)
    return dict(zip(names, w.tolist()))


def _extract(fields: list[str], weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "html"):
            found = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            made = [pa.array([x[0] for x in found], pa.string()), *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3))]
            yield pa.record_batch([batch.column(f) for f in fields] + made, names=[*fields, "text", "n_blocks", "n_kept", "n_turned"])

    return run


def extract(pages: DataFrame, weights: dict[str, float] = PRIOR, source: str = "html") -> DataFrame:
    """pages without their source column, with text, n_blocks, n_kept and n_turned (labels that the cut has turned).

    A null or empty page has an empty text and no blocks.  Columns named like
    the added ones are replaced.
    """
    added = ("text", "n_blocks", "n_kept", "n_turned")
    rest = [c for c in pages.columns if c not in (*added, source)]
    inner = [f"c{i}" for i in range(len(rest))]
    frame = pages.select(*[exact(c).alias(n) for c, n in zip(rest, inner)], F.coalesce(exact(source), F.lit("")).alias("html"))
    shape = "".join(f"{n} {pages.schema[c].dataType.simpleString()}, " for c, n in zip(rest, inner))
    return frame.mapInArrow(_extract(inner, weights), f"{shape}text string, n_blocks bigint, n_kept bigint, n_turned bigint").withColumnsRenamed(dict(zip(inner, rest)))
