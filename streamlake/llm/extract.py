"""Main text of web pages.

A page is read into a tree of block elements. Boosted trees judge every block element by its subtree's
text and link density, its attribute tokens, its depth and its place among its siblings. Then the most likely
labelling is chosen among those that do not contradict themselves: what is not part of the
article has no part of the article inside. The model learns from pages laid out at random around the texts
of a bounded sample of the table.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlake.llm.boosting import Boosted, fit
from streamlake.llm.common import fetched, sample_of

TRAINING_PAGES = 400  # sampled for their texts
TRAINING_BYTES = 200_000  # a larger page is not sampled
LAYOUTS = 3  # pages laid out around each

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset("script style template noscript iframe object svg math canvas head title select option "
                   "button textarea datalist audio video map".split())
BLOCK = frozenset("html body article main section nav aside header footer div p ul ol li dl dt dd h1 h2 h3 "
                  "h4 h5 h6 table caption thead tbody tfoot tr td th blockquote pre figure figcaption form "
                  "fieldset address hr details summary center hgroup menu dialog search".split())
# A start tag of the key ends open elements of the value, up to the nearest element of the last column.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
        "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
        "tbody": ({"thead", "tbody", "tr", "td"}, {"table"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TOKENS = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs header masthead banner topbar footer "
    "bottombar copyright sidebar aside rail widget ad ads adv advert adverts advertisement sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login form search comment comments respond reply discussion disqus share "
    "sharing social related recommended recommendations more toolbar pagination pager tags legal "
    "skip".split())
ARTICLE_TOKENS = frozenset("article content main post entry story body text page blog news".split())
COMMENT_TOKENS = frozenset("comment comments respond reply discussion disqus".split())
KINDS = ("article", "main", "section", "nav", "aside", "header", "footer", "div", "p", "ul", "ol", "li",
         "table", "td", "form", "blockquote", "pre")

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""",
    re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I)
            for name in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|data-part)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_TOKEN = re.compile("[a-z]+")


class Page:
    """Block elements of a page in document order: ``tag, parent, depth, tokens, mark`` by node, and its
    text blocks ``(node, text, linked characters)``."""

    __slots__ = ("blocks", "depth", "mark", "parent", "tag", "tags", "tokens")

    def __init__(self, html: str):
        self.tag, self.parent, self.depth = ["html"], [-1], [0]
        self.tokens, self.mark, self.tags = [()], [None], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        # The open elements: name, the block node they stand for or are in, whether their text counts.
        stack = [("html", 0, True)]
        held: list[str] = []
        linked = links = at = 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join(unescape("".join(held)).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked))
                held.clear()
            linked = 0

        def close(to: int) -> None:
            nonlocal links
            for name, *_ in stack[to:]:
                if name in BLOCK:
                    flush()
                elif name == "a":
                    links -= 1
                stack.pop()

        while at < len(html):
            found = _TAG.search(html, at)
            end = found.start() if found else len(html)
            if end > at and stack[-1][2]:
                piece = html[at:end]
                held.append(piece)
                if links:
                    linked += len(piece.strip())
            if not found:
                break
            at = found.end()
            name = found["name"]
            if not name:
                continue
            name = name.lower()
            if found["end"]:
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place][0] == name:
                        # Text in front of an end tag belongs to the innermost open block.
                        if any(n in BLOCK for n, *_ in stack[place:]):
                            flush()
                        close(place)
                        break
                continue
            node, read = stack[-1][1], stack[-1][2]
            self.tags[node] += 1
            if name in VOID:
                held.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in _RAW_END:
                raw = _RAW_END[name].search(html, at)
                at = raw.end() if raw else len(html)
                continue
            if name in ("html", "body"):
                continue
            if name in BLOCK:
                flush()
                for place in range(len(stack) - 1, 0, -1):
                    inner = stack[place][0]
                    if inner == "p":
                        close(place)
                        break
                    if inner in BLOCK:
                        break
                if name in ENDS:
                    ends, until = ENDS[name]
                    for place in range(len(stack) - 1, 0, -1):
                        if stack[place][0] in until:
                            break
                        if stack[place][0] in ends:
                            close(place)
                            break
                if name in HEADINGS and stack[-1][0] in HEADINGS:
                    close(len(stack) - 1)
                parent = stack[-1][1]
                tokens, mark = (), None
                if "=" in found["rest"]:
                    values = []
                    for key, value in _ATTRIBUTE.findall(found["rest"]):
                        if key.lower() == "data-part":
                            mark = value.strip("\"'")
                        else:
                            values.append(value.lower())
                    tokens = tuple(_TOKEN.findall(" ".join(values)))
                node = len(self.tag)
                self.tag.append(name)
                self.parent.append(parent)
                self.depth.append(self.depth[parent] + 1)
                self.tokens.append(tokens)
                self.mark.append(mark)
                self.tags.append(0)
            elif name == "a":
                links += 1
            stack.append((name, node, read and name not in UNREAD))
        close(1)
        flush()


def measures(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of all pages, the parent of each node, and the first node of each page."""
    firsts = np.cumsum([0, *(len(p.tag) for p in pages)])
    total = int(firsts[-1])
    parent = np.full(total, -1)
    depth = np.zeros(total, np.int64)
    own = np.zeros((total, 9))  # characters, linked, words, sentence ends, commas, blocks, tags, p, headings
    kind = np.zeros((total, len(KINDS) + 1))
    token = np.zeros((total, 3))
    for first, page in zip(firsts, pages, strict=False):
        last = first + len(page.tag)
        parent[first:last] = page.parent
        parent[first + 1:last] += first
        depth[first:last] = page.depth
        own[first:last, 6] = page.tags
        for node, text, linked in page.blocks:
            row = own[first + node]
            row[0] += len(text)
            row[1] += min(linked, len(text))
            row[2] += text.count(" ") + 1
            row[3] += text.count(". ") + text.endswith((".", "!", "?"))
            row[4] += text.count(",")
            row[5] += 1
        for node, (tag, tokens) in enumerate(zip(page.tag, page.tokens, strict=True), first):
            if tag in HEADINGS:
                kind[node, -1] = own[node, 8] = 1
            elif tag in KINDS:
                kind[node, KINDS.index(tag)] = 1
            own[node, 7] = tag == "p"
            if tokens:
                token[node] = [sum(t in BOILERPLATE_TOKENS for t in tokens),
                               sum(t in ARTICLE_TOKENS for t in tokens),
                               sum(t in COMMENT_TOKENS for t in tokens)]
    subtree = own.copy()
    for level in range(int(depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(depth == level)
        np.add.at(subtree, parent[at], subtree[at])
    up = np.maximum(parent, 0)
    page_of = np.repeat(firsts[:-1], np.diff(firsts))
    whole = subtree[page_of]
    siblings = np.bincount(up[parent >= 0], minlength=total)
    order = np.arange(total)
    rank = np.zeros(total)
    by_parent = np.lexsort((order, parent))
    starts = np.concatenate([[True], parent[by_parent][1:] != parent[by_parent][:-1]])
    run = np.arange(total) - np.maximum.accumulate(np.where(starts, np.arange(total), 0))
    rank[by_parent] = run
    chars = subtree[:, 0]
    density = np.divide(subtree[:, 1], chars, out=np.zeros(total), where=chars > 0)
    # Of the neighbours: the link density of the sibling in front of and behind a node.
    side = np.zeros((total, 2))
    same = ~starts[1:]
    side[by_parent[1:][same], 0] = density[by_parent[:-1][same]]
    side[by_parent[:-1][same], 1] = density[by_parent[1:][same]]
    # Kind and tokens of what a node is in.
    above = np.zeros((total, 4))
    marked = np.stack([token[:, 0], token[:, 1],
                       kind[:, [KINDS.index(k) for k in ("nav", "aside", "header", "footer", "form")]].sum(1),
                       kind[:, [KINDS.index(k) for k in ("article", "main")]].sum(1)], axis=1)
    for level in range(1, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == level)
        above[at] = above[parent[at]] + marked[parent[at]]
    per = np.maximum(subtree[:, 5], 1)
    features = np.column_stack([
        kind, token, above, depth, np.log1p(chars), np.log1p(subtree[:, 2]), density,
        chars / np.maximum(subtree[:, 6], 1), chars / per, subtree[:, 2] / per,
        subtree[:, 3] / np.maximum(subtree[:, 2], 1), subtree[:, 4] / np.maximum(subtree[:, 2], 1),
        np.log1p(subtree[:, 5]), np.log1p(subtree[:, 7]), subtree[:, 8],
        chars / np.maximum(whole[:, 0], 1), chars / np.maximum(subtree[up][:, 0], 1),
        siblings[up], rank, rank / np.maximum(siblings[up] - 1, 1), side, density[up],
        (order - page_of) / np.maximum(np.diff(firsts).repeat(np.diff(firsts)), 1)])
    return features, parent, firsts


def decode(log_odds: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The most likely labels in which no node is in while its parent is out. Nodes stand in
    document order, a root has parent -1 and is in."""
    inside = -np.logaddexp(0, -log_odds) * weight
    outside = -np.logaddexp(0, log_odds) * weight
    all_out, best = outside.copy(), inside.copy()
    for node in range(len(parent) - 1, -1, -1):  # children stand behind their parents
        best[node] = max(best[node], all_out[node])
        if parent[node] >= 0:
            all_out[parent[node]] += all_out[node]
            best[parent[node]] += best[node]
    # `best` of a node now holds the better of its two cases; it is in if the first of them is.
    label = np.zeros(len(parent), bool)
    for node in range(len(parent)):
        label[node] = parent[node] < 0 or (label[parent[node]] and best[node] > all_out[node])
    return label


def main_text(page: Page, label: np.ndarray) -> str:
    return "\n".join(text for node, text, _ in page.blocks if label[node])


def extract_all(htmls: list[str | None], model: Boosted) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    features, parent, firsts = measures(pages)
    odds = model.log_odds(features)
    out = []
    for page, first, last in zip(pages, firsts[:-1], firsts[1:], strict=True):
        own = np.where(parent[first:last] >= 0, parent[first:last] - first, -1)
        out.append(main_text(page, decode(odds[first:last], own, np.ones(last - first))))
    return out


def _pieces(page: Page) -> tuple[list[str], list[str]]:
    """Long and short texts of a page, as material for layouts."""
    texts = [t for _, t, _ in page.blocks]
    return [t for t in texts if len(t) >= 80], [t for t in texts if len(t) < 80]


def lay_out(long: list[str], short: list[str], draw: np.random.Generator) -> str:
    """A page around the texts, with ``data-part`` 1 on what belongs to the article and 0 on what does
    not."""
    from html import escape

    def some(texts, n):
        return [escape(texts[i]) for i in draw.integers(0, len(texts), n)] if texts else [""] * n

    def pick(*of):
        return of[draw.integers(len(of))]

    def chance(p):
        return draw.random() < p

    def wrap(part, body, *openings):
        opening = pick(*openings)
        return f'<{opening} data-part={part}>{body}</{opening.split()[0]}>'

    def cut(texts, low, high):
        return [" ".join(t.split()[:int(draw.integers(low, high))]) for t in texts]

    def menu(n):
        items = "".join(f'<li><a href="/x">{t}</a></li>' for t in cut(some(short + long, n), 1, 4))
        return f"<ul>{items}</ul>"

    def sentences(n):
        return cut(some(long + short, n), 5, 60)

    parts = []
    if chance(0.5):
        parts.append(wrap(0, f"<p>{cut(some(short + long, 1), 2, 6)[0]}</p>" + (menu(3) if chance(0.4) else ""),
                          "header", 'div class="site-header"', 'div id="masthead"', 'div class="top"'))
    if chance(0.8):
        parts.append(wrap(0, menu(int(draw.integers(3, 12))), "nav", 'div class="menu"', 'div id="navigation"',
                          'div role="navigation"', "div"))
    if chance(0.4):
        parts.append(wrap(0, "".join(f"<p>{t}</p>" for t in cut(sentences(1), 5, 25)), 'div class="cookie-notice"',
                          'div id="consent"', 'div class="notice banner"', 'section class="alert"'))

    def advert():
        return wrap(0, cut(sentences(1), 3, 25)[0], 'div class="ad"', 'div class="advert"', 'aside class="promo"',
                    'div class="sponsored"')

    if chance(0.6):
        parts.append(advert())
    body = []
    if chance(0.8):
        body.append(f"<h1>{cut(some(short + long, 1), 3, 12)[0]}</h1>")
    for text in some(long + short, int(draw.integers(1, 14))):
        if chance(0.15):
            text = " ".join(text.split()[:int(draw.integers(1, 6))])
        body.append(pick(f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}</p>", f"<div>{text}</div>",
                         f"<h2>{' '.join(text.split()[:6])}</h2><p>{text}</p>", f"<blockquote>{text}</blockquote>",
                         f"<ul><li>{text}</li><li>{text[:40]}</li></ul>", f'<p>{text} <a href="/y">{text[:12]}</a></p>'))
        if chance(0.06):
            body.append(advert())
        if chance(0.04):
            body.append(wrap(0, menu(3), 'div class="share"', 'div class="related"', "aside"))
    parts.append(wrap(1, "".join(body), "article", "article", "main", 'div class="content"', 'div class="post entry"',
                      'div id="main"', "div", 'section class="story"'))
    after = []
    if chance(0.4):
        posts = "".join(f'<div class="comment"><p>{t}</p></div>' for t in sentences(int(draw.integers(1, 6))))
        after.append(wrap(0, posts, 'section id="comments"', 'div class="comments"', 'div class="discussion"'))
    if chance(0.4):
        after.append(wrap(0, menu(5) + "".join(f"<p>{t}</p>" for t in cut(sentences(2), 4, 20)), "aside",
                          'div class="sidebar"', 'div id="rail"', 'div class="widget"'))
    if chance(0.3):
        after.append(wrap(0, f"<label>{cut(sentences(1), 2, 6)[0]}</label><input>", "form", 'form class="newsletter"',
                          'div class="subscribe"'))
    if chance(0.8):
        after.append(wrap(0, "&copy; " + cut(sentences(1), 3, 20)[0], "footer", 'div class="footer"', 'div id="copyright"'))
    if chance(0.15):
        after.reverse()
    return "<html><body>" + "".join(parts + after) + "</body></html>"


def marks(page: Page) -> np.ndarray:
    """For each node 1 or 0 by the nearest mark on it or above it, -1 where there is none."""
    out = []
    for parent, mark in zip(page.parent, page.mark, strict=True):
        out.append(int(mark) if mark in ("0", "1") else out[parent] if parent >= 0 else -1)
    return np.array(out)


def train(pages: DataFrame, sample: int = TRAINING_PAGES, layouts: int = LAYOUTS) -> Boosted:
    """A model of what belongs to an article, from layouts around the texts of about ``sample`` pages.

    Nothing of a page's own markup is taken as true: a layout's parts are known because it was made here.
    """
    usable = pages.where((F.octet_length("html") > 0) & (F.octet_length("html") <= TRAINING_BYTES))
    rows = fetched(sample_of(usable, sample, F.col("page_id")).select("html"))
    draw = np.random.default_rng(7)
    material = [_pieces(Page(html)) for html in rows["html"]]
    made = [Page(lay_out(long, short, draw)) for long, short in material if long or short
            for _ in range(layouts)]
    if not made:
        return fit(np.zeros((0, 1)), np.zeros(0))
    features, _, _ = measures(made)
    label = np.concatenate([marks(p) for p in made])
    known = label >= 0
    return fit(features[known], label[known].astype(np.float64))


def extract(pages: DataFrame, model: Boosted, keep: str = "page_id") -> DataFrame:
    """Main text of ``pages (html)``: ``keep`` (a column passed on), ``text``.

    Character references are decoded, white space inside a block becomes one space, blocks that belong to
    the article are joined by line ends. A null or empty html, and a page without any text of its own, give
    an empty text; unclosed and crossing tags are read as browsers do, roughly. Other columns are ignored.
    """
    kind = pages.select(keep).schema[0].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extracted(batches):
        for batch in batches:
            htmls = batch.column(1).to_pylist()
            texts = [t for at in range(0, len(htmls), 200) for t in extract_all(htmls[at:at + 200], shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [keep, "text"])

    return pages.select(keep, "html").mapInArrow(extracted, f"`{keep}` {kind}, text string")
