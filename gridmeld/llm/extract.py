"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A tolerant tokeniser builds the tree of block elements. Each block has features of
its subtree's text and link density, its tag and attribute tokens, its depth and its
siblings; boosted trees turn them into a score for being part of the article. The
decoder then chooses for every subtree to keep it whole, to drop it whole or to
leave the choice to its children, so no kept block lies in a dropped one.

The trees are trained on pages made from templates with known parts, since page
tables carry no labels. Half of the templates have names that say nothing, and often
plain boxes instead of telling elements, so that length, links, place and repeated shapes must decide there.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import boosting
from .common import shipped

MARKUP = re.compile(r"<(?=/?[A-Za-z]|[!?/])")
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
QUOTE = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
DIGITS = re.compile("[0-9]")
SPACE = re.compile(r"[ \t\n\r\f\v]+")

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object head".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html option label button select textarea legend caption summary".split())
SIBLING_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
# Attribute tokens that tell of an article, and of what surrounds one.
GOOD = frozenset("article articlebody body content entry hentry main maincontent post postbody prose story text".split())
BAD = frozenset("ad ads adv advert advertisement alert aside banner bar bio breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright crumbs disclaimer disqus discussion dropdown foot footer form gdpr head header hidden legal links login masthead menu meta modal more nav navbar navigation newsletter notice overlay pager pagination popup privacy promo promotion recommended register related reply replies respond rail search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar tools top trending widget widgets".split())
TAGS = ["p", "div", "article", "main", "section", "nav", "aside", "header", "footer", "form", "li", "ul", "table", "td", "h1", "h2", "blockquote", "pre", "body", "button"]


class Node:
    """A block element; `pieces` are its own texts and its child blocks in order."""

    __slots__ = ("tag", "tokens", "parent", "children", "pieces", "own", "linked", "inline", "hidden")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: "Node | None", hidden: bool = False) -> None:
        self.tag, self.tokens, self.parent, self.hidden = tag, tokens, parent, hidden
        self.children: list[Node] = []
        self.pieces: list[str | Node] = []
        self.own = self.linked = self.inline = 0


def _tokens(attributes: str) -> tuple[tuple[str, ...], bool]:
    found, hidden = [], False
    if "=" in attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                found += [t.lower() for t in TOKEN.findall(value)]
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value == "true":
                hidden = True
    return tuple(found), hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))


class Closings:
    """Finds the sign that ends a tag, for pages with tags that don't end as they should.

    What stands in quotes ends no tag. Whether a tag ends is the same from each sign
    outside of quotes on, so signs that lead nowhere are remembered and each is passed
    twice at most, however many tags are broken.
    """

    def __init__(self, page: str, start: int) -> None:
        self.at = [m.start() for m in QUOTE.finditer(page, start)]
        self.page, self.partner, self.lost = page, [len(self.at)] * len(self.at), set()
        last: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            sign = page[self.at[i]]
            self.partner[i] = last.get(sign, len(self.at))
            last[sign] = i

    def ends(self, tag: int) -> bool:
        passed, i = [], bisect_left(self.at, tag)
        while i < len(self.at) and i not in self.lost:
            if self.page[self.at[i]] == ">":
                return True
            passed.append(i)
            i = self.partner[i] + 1
        self.lost.update(passed)
        return False


def parse(page: str) -> Node:
    """The tree of block elements. Unknown, unclosed and stray tags are tolerated; the
    time stays in proportion to the page, whatever is broken in it."""
    root = Node("html", (), None)
    open_, where = [root], {}  # the open elements, and by tag their places among these
    node, at, n = root, 0, len(page)
    in_link = False
    last_end = page.rfind(">")
    closings: Closings | None = None
    absent: set[str] = set()

    def text(piece: str) -> None:
        if piece:
            node.pieces.append(piece)
            size = len(piece) - piece.count(" ")
            node.own += size
            if in_link:
                node.linked += size

    def close(place: int) -> Node:
        """Closes the element at a place and all in it."""
        while len(open_) > place:
            where[open_.pop().tag].pop()
        return open_[-1]

    def after_end(tag: str) -> int:
        """Where the text after the next end tag begins, -1 if there is none."""
        m = None if tag in absent else re.compile(rf"</{re.escape(tag)}", re.I).search(page, at)
        end = -1 if m is None else page.find(">", m.end())
        if end < 0:
            absent.add(tag)
        return end + 1 if end >= 0 else -1

    while at < n:
        sign = MARKUP.search(page, at)
        if sign is None:
            text(page[at:])
            break
        lt = sign.start()
        text(page[at:lt])
        if lt > last_end:  # what never ends takes the rest with it
            break
        if not page[lt + 1].isalpha() and (page[lt + 1] != "/" or not page[lt + 2 : lt + 3].isalpha()):  # comment, declaration, instruction or stray end
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + (4 if comment else 2))
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        m = TAG.match(page, lt) if closings is None or closings.ends(lt) else None
        if m is None:  # a broken quote
            closings = closings or Closings(page, lt)
            m = LOOSE.match(page, lt)
        if m is None:
            text("<")
            at = lt + 1
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if tag in RAW and tag != "head" and not closing:
            if not attributes.endswith("/"):
                end = after_end(tag)
                at = end if end >= 0 else n if tag in ("script", "style") else at
            continue
        if tag == "title" and not closing:
            end = after_end(tag)
            at = end if end >= 0 else at
            continue
        if tag == "br":
            node.pieces.append(" ")
            continue
        if tag == "a":
            in_link = not closing
            node.inline += 1
            continue
        if tag not in BLOCK:
            if not closing:
                node.inline += 1
            continue
        if closing:
            if where.get(tag):
                node = close(where[tag][-1])
            in_link = False
            continue
        if tag in CLOSES_P and (node.tag == "p" or tag in HEADINGS and node.tag in HEADINGS):
            place = len(open_)
            while open_[place - 1].tag == "p" or open_[place - 1].tag in HEADINGS:
                place -= 1
            node = close(place)
        if tag in SIBLING_END:
            scope = max((where[t][-1] for t in SCOPE[tag] if where.get(t)), default=0)
            found = [w[k] for t in SIBLING_END[tag] if (w := where.get(t)) and (k := bisect_right(w, scope)) < len(w)]
            if found:
                node = close(min(found))
        tokens, hidden = _tokens(attributes)
        child = Node(tag, tokens, node, hidden)
        node.children.append(child)
        node.pieces.append(child)
        if tag not in VOID:
            where.setdefault(tag, []).append(len(open_))
            open_.append(child)
            node = child
    return root


def nodes_of(root: Node) -> list[Node]:
    """The nodes in page order, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features per node."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    size, linked, count, inline, paragraphs, stops, items = (np.zeros(n) for _ in range(7))
    parent = np.zeros(n, dtype=np.int64)
    depth, good, bad, good_above, bad_above, tag_above, position, siblings, alike = (np.zeros(n) for _ in range(9))
    prose, titles, texts, digits, same, same_above, same_below, beside, largest, starts = (np.zeros(n) for _ in range(10))
    for i, x in enumerate(nodes):
        size[i], linked[i], count[i], inline[i] = x.own, x.linked, 1, x.inline
        paragraphs[i] = x.tag == "p" and x.own > 20
        items[i] = x.tag == "li"
        stops[i] = sum(p.count(".") + p.count(",") for p in x.pieces if type(p) is str)
        digits[i] = sum(len(DIGITS.findall(p)) for p in x.pieces if type(p) is str)
        prose[i], titles[i], texts[i] = x.own * (x.tag == "p" and x.own > 20), x.tag == "h1", x.own > 0
        good[i] = sum(t in GOOD for t in x.tokens) + (x.tag in ("article", "main"))
        bad[i] = sum(t in BAD for t in x.tokens) + (x.tag in ("nav", "aside", "footer", "form", "header", "button", "select", "menu", "dialog")) + 2 * x.hidden
        if i:
            p = at[id(x.parent)]
            parent[i] = p
            depth[i] = depth[p] + 1
            good_above[i], bad_above[i] = good_above[p] + good[p], bad_above[p] + bad[p]
            tag_above[i] = 1 if x.parent.tag in ("article", "main") else tag_above[p] * 0.9
            same_above[i] = max(same_above[p], same[i])
        kinds: dict[str, int] = {}
        shapes: dict[tuple, int] = {}
        for c in x.children:
            kinds[c.tag] = kinds.get(c.tag, 0) + 1
            if c.children:  # a box; boxes of one shape next to each other are entries of a list
                shape = c.tag, tuple(b.tag for b in c.children[:4])
                shapes[shape] = shapes.get(shape, 0) + 1
        same_below[i] = max(shapes.values(), default=0)
        for k, c in enumerate(x.children):
            j = at[id(c)]
            same[j] = shapes[c.tag, tuple(b.tag for b in c.children[:4])] - 1 if c.children else 0
            beside[j] = kinds.get("p", 0) / len(x.children)
            position[j], siblings[j], alike[j] = k / max(1, len(x.children) - 1), len(x.children), kinds[c.tag] / len(x.children)
    own = size.copy()
    starts[1:] = np.cumsum(own)[:-1]
    for i in range(n - 1, 0, -1):
        for a in (size, linked, count, inline, paragraphs, stops, items, prose, titles, texts, digits):
            a[parent[i]] += a[i]
        largest[parent[i]] = max(largest[parent[i]], size[i])
    total, all_prose = max(1.0, size[0]), max(1.0, prose[0])
    tags = np.zeros((n, len(TAGS)))
    for i, x in enumerate(nodes):
        if x.tag in TAGS:
            tags[i, TAGS.index(x.tag)] = 1
    share = size / np.maximum(size[parent], 1)
    base = np.column_stack([
        np.log1p(size), np.log1p(own), linked / np.maximum(size, 1), size / (count + inline), np.log1p(count), np.log1p(paragraphs), items / count, stops / np.maximum(size, 1),
        size / total, share, depth, position, np.log1p(siblings), alike, good, bad, np.minimum(good_above, 3), np.minimum(bad_above, 3), tag_above,
        linked[parent] / np.maximum(size[parent], 1), np.log1p(paragraphs[parent]), good[parent], bad[parent],
        prose / all_prose, prose[parent] / all_prose, prose / np.maximum(prose[parent], 1), np.minimum(titles, 2), np.minimum(titles[parent], 2), size / np.maximum(texts, 1), digits / np.maximum(size, 1),
        np.log1p(same), np.log1p(same_above), np.log1p(same_below), beside, size / np.maximum(largest[parent], 1), starts / total, size[parent] / np.maximum(texts[parent], 1),
    ])
    return np.concatenate([base, tags], axis=1)


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """Which nodes keep their own text: for each subtree the best of keeping it whole,
    dropping it whole, or (at a small cost) choosing for each part."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    parent = [0] + [at[id(x.parent)] for x in nodes[1:]]
    own = np.array([x.own for x in nodes], dtype=float)
    score = np.clip(logits, -6, 6) * np.log1p(own)
    whole, parts = score.copy(), np.abs(score)
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best[i] = max(abs(whole[i]), parts[i] - 0.5)
        if i:
            whole[parent[i]] += whole[i]
            parts[parent[i]] += best[i]
    keep, fixed = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for i in range(n):
        if i and fixed[parent[i]]:
            fixed[i], keep[i] = True, keep[parent[i]]
        elif abs(whole[i]) >= parts[i] - 0.5:
            fixed[i], keep[i] = True, whole[i] > 0
        else:
            keep[i] = score[i] > 0
    return keep


def assemble(root: Node, keep: dict[int, bool]) -> str:
    """The kept texts in page order: references decoded, white space inside a block
    one blank, blocks joined by one blank."""
    out: list[str] = []
    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, k = stack.pop()
        while k < len(node.pieces):
            piece = node.pieces[k]
            k += 1
            if type(piece) is str:
                if keep[id(node)]:
                    out.append(piece)
            else:
                out.append(" ")
                stack.append((node, k))
                node, k = piece, 0
        out.append(" ")
    return SPACE.sub(" ", entities.unescape("".join(out)).replace("\xa0", " ")).strip(" ")


WORDS = "lor mi santa vero kel tindo para ose quim alte beno ruda fes hilo junta nor pel gavo tri uma wex yol zand crem drof".split()


def _sentence(rng: np.random.Generator, low: int, high: int) -> str:
    w = ["".join(rng.choice(WORDS, rng.integers(1, 4))) for _ in range(rng.integers(low, high))]
    return " ".join(w).capitalize() + "."


def template_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page from random parts, and the marks of the blocks that are its article.

    Each text begins with a mark of its own, which tells afterwards whose it is. Half of the
    pages are nameless().
    """
    marks: set[str] = set()
    serial = [0]

    def mark(main: bool) -> str:
        serial[0] += 1
        name = f"q{serial[0]}z "
        if main:
            marks.add(name.strip())
        return name

    pick = lambda *x: x[rng.integers(len(x))]
    # numbers, dates and links to what is meant stand in articles, too
    figures = lambda: "" if rng.random() < 0.75 else " " + pick(".", "-", " ", "/").join(str(rng.integers(1, 10 ** rng.integers(1, 6))) for _ in range(rng.integers(1, 5)))
    links = lambda n: "".join(f'<li><a href="/x">{mark(False)}{_sentence(rng, 1, 4)}</a></li>' for _ in range(n))
    prose = lambda n, low=12, high=60: "".join(f"<p>{pick('', '<b>', '<em>', '')}{mark(True)}{' '.join(_sentence(rng, low, high) + figures() for _ in range(rng.integers(1, 4)))}{pick('</p>', '</p>', '<br>', '')}" for _ in range(n))

    def other() -> str:
        kind = rng.integers(13)
        t = lambda a, b: mark(False) + _sentence(rng, a, b)
        signed = rng.random() < 0.5
        by = lambda: f"<{pick('p', 'div', 'h4')}>{mark(False)}{_sentence(rng, 1, 3)} {rng.integers(1, 29)}.{rng.integers(1, 13)}.20{rng.integers(10, 30)}</p>" if signed else ""
        if kind == 0:
            return f"<nav>{pick('<ul>', '<ul class=menu>')}{links(rng.integers(2, 12))}</ul></nav>"
        if kind == 1:
            return f'<div class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo box")}">{t(3, 30)}</div>'
        if kind == 2:
            return f'<{pick("aside", "div")} class="{pick("sidebar", "widget", "rail", "related")}"><h3>{t(1, 4)}</h3><p>{t(5, 40)}</p><ul>{links(rng.integers(1, 8))}</ul></{pick("aside", "div")}>'
        if kind == 3:
            return f'<div id="{pick("cookie-notice", "consent", "gdprBanner", "cookies")}"><p>{t(8, 30)}</p><button>{t(1, 3)}</button></div>'
        if kind == 4:
            return f'<section class="{pick("comments", "comment-list", "discussion", "replies")}">' + "".join(f'<div class="{pick("comment", "reply", "")}">{by()}<p>{t(1, 8) if rng.random() < 0.3 else t(5, 50)}</p></div>' for _ in range(rng.integers(1, 8))) + "</section>"
        if kind == 5:
            return f"<form action=/s><label>{t(1, 4)}</label><input name=q><button>{t(1, 2)}</button></form>"
        if kind == 6:
            return f'<div class="{pick("share", "social", "toolbar", "tags")}"><ul>{links(rng.integers(2, 6))}</ul></div>'
        if kind == 7:
            return f'<{pick("div", "ol")} class="{pick("breadcrumb", "breadcrumbs", "pager")}">{links(rng.integers(2, 5))}</{pick("div", "ol")}>'
        if kind == 8:
            return f"<header><h2>{t(1, 4)}</h2><p>{t(2, 9)}</p></header>"
        if kind == 9:
            return f'<div class="{pick("newsletter", "subscribe", "signup", "login")}"><h4>{t(1, 5)}</h4><p>{t(5, 25)}</p></div>'
        if kind == 10:
            return f'<div class="{pick("notice", "alert", "popup", "modal")}">{t(4, 25)}</div>'
        if kind == 11:
            return f"<aside>{t(3, 40)}</aside>"
        return f"<div style='display:none'>{t(3, 20)}</div>"

    size = rng.integers(1, 12)
    body = f"<h1>{mark(True)}{_sentence(rng, 3, 12)}</h1>" if rng.random() < 0.85 else ""
    body += prose(size) if rng.random() < 0.88 else prose(rng.integers(1, 3), 6, 20)
    if rng.random() < 0.3:
        body += f"<h2>{mark(True)}{_sentence(rng, 2, 7)}</h2>" + prose(rng.integers(1, 4))
    if rng.random() < 0.2:
        body += "<ul>" + "".join(f"<li>{mark(True)}{_sentence(rng, 4, 25)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>"
    if rng.random() < 0.15:
        body += f"<blockquote>{prose(1)}</blockquote>"
    if rng.random() < 0.1:
        body += "<table>" + "".join(f"<tr><td>{mark(True)}{_sentence(rng, 1, 5)}</td><td>{mark(True)}{_sentence(rng, 1, 5)}</td></tr>" for _ in range(rng.integers(2, 5))) + "</table>"
    if rng.random() < 0.25:
        body += other()
    if rng.random() < 0.2:
        body = other() + body
    box = pick("<article>|</article>", "<article>|</article>", "<main>|</main>", '<div id="content">|</div>', '<div class="post-body">|</div>', '<div class="entry-content">|</div>', "<main><article>|</article></main>", '<section class="story">|</section>', "<div>|</div>", "<div><div>|</div></div>", "<table><tr><td>|</td></tr></table>").split("|")
    before = "".join(other() for _ in range(rng.integers(0, 4)))
    after = "".join(other() for _ in range(rng.integers(0, 4)))
    foot = f'<{pick("footer", "footer", "div class=footer")}>&copy; {mark(False)}{_sentence(rng, 2, 20)}{"<ul>" + links(3) + "</ul>" if rng.random() < 0.4 else ""}</{pick("footer", "div")}>' if rng.random() < 0.85 else ""
    page = before + box[0] + body + box[1] + after + foot
    if rng.random() < 0.3:
        page = f'<div class="{pick("wrapper", "page", "container", "site")}">{page}</div>'
    if rng.random() < 0.5:
        page = nameless(page, rng)
    return f"<!DOCTYPE html><html><head><title>{_sentence(rng, 2, 8)}</title></head><body>{page}</body></html>", marks


def nameless(page: str, rng: np.random.Generator) -> str:
    """The page with names in no list for its classes and ids, the same for the same name, and on
    every second page plain boxes for elements that tell what they hold."""
    style, names = rng.integers(3), {}

    def name(found: re.Match) -> str:
        if found[2] not in names:
            word = "".join(rng.choice(WORDS, 2))
            names[found[2]] = (word, f"css{rng.integers(10)}{word[:2]}{rng.integers(100)}", f"{word[0]}{rng.integers(10)}")[style]
        return f'{found[1]}="{names[found[2]]}"'

    page = re.sub(r"""(class|id)=["']?([^"'>]*)["']?""", name, page)
    if rng.random() < 0.5:
        page = re.sub(r"<(/?)(?:nav|aside|header|footer|article|main|section)(?=[ >])", r"<\1div", page)
    return page


@lru_cache(maxsize=4)
def train(pages: int = 700, seed: int = 11) -> boosting.Boosted:
    """The trees from `pages` template pages; each block with words of its own is a row,
    and so is each other block whose texts are all of one kind. The same arguments give the same trees, kept for the process."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, marks = template_page(rng)
        nodes = nodes_of(parse(page))
        at = {id(x): i for i, x in enumerate(nodes)}
        yes, no = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i, x in enumerate(nodes):
            found = re.findall(r"\bq\d+z\b", " ".join(p for p in x.pieces if type(p) is str))
            yes[i], no[i] = sum(f in marks for f in found), sum(f not in marks for f in found)
        own = yes + no > 0
        for i in range(len(nodes) - 1, 0, -1):
            p = at[id(nodes[i].parent)]
            yes[p] += yes[i]
            no[p] += no[i]
        use = own | ((yes == 0) != (no == 0))
        xs.append(features(nodes)[use])
        ys.append((yes > no)[use])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float), trees=64, depth=5)


def main_text(pages: list[str | None], trees: boosting.Boosted) -> list[str]:
    """The main text of each page."""
    found = [nodes_of(parse(p)) if p else [] for p in pages]
    rows = [features(n) for n in found if n]
    logits = trees.logits(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in found:
        if not nodes:
            out.append("")
            continue
        keep = decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        out.append(assemble(nodes[0], {id(x): k and not x.hidden for x, k in zip(nodes, keep)}))
    return out


def extract(pages: DataFrame, trees: boosting.Boosted | None = None, html_col: str = "html") -> DataFrame:
    """Replaces the html of pages by text, the article's text (empty if there is
    none), and adds n_chars, its code points; both replace columns of these names.

    Defined cases: null and empty html give an empty text; html without markup is
    judged as one block; each page is treated by itself and whole, so repeated rows
    and empty tables need no care; the time for a page grows with its length only,
    also where tags, quotes or elements are left open.
    """
    trees = trees or train()
    sent = shipped(pages.sparkSession, trees)
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    slim = pages.select(*[f"`{f.name}`" for f in kept], html_col)
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = main_text(part.column(len(names)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return slim.mapInArrow(run, schema)
