"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a row of items: words score positive, tags negative, and a run of
boilerplate (menus, forms, adverts, comments, scripts ...) is one costly gap.  One linear
scan finds the contiguous run of items with the highest sum, and its words outside gaps
are the text.  The weights are log-odds fitted on labelled pages (``LABELLED``; ``fit``
takes others): how often an item of a kind lies inside the marked text, or outside.

Null and empty pages give an empty text; unclosed tags, comments and attributes are read
as browsers read them; a page is parsed whole in time linear in its length; repeated rows
give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_rows

# Element and class names of HTML pages.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROP = set("nav aside footer form button select option datalist dialog menu object svg canvas audio video map applet frameset".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar tablist toolbar status".split())
_CONTENT, _NEVER = {"article", "main"}, {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "a", "b", "i", "em", "strong", "code", "pre"}
_NAMES = (
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored "
    "promo promotion cookie cookies cookiebar notice notices notification alert popup modal overlay newsletter subscribe subscription signup social share sharing sharebar related recommended "
    "recommendations comment comments commentlist disqus respond reply replies widget widgets pagination pager toolbar skip consent gdpr login search searchbox topbar copyright legal disclaimer tags"
).split()
_CLASS = re.compile(rf"(?:(?:site|page|main|top|global|left|right|bottom|primary|secondary|user|reader|blog|google|mobile|inline|text|display|js)[-_]?)?({'|'.join(sorted(_NAMES, key=len, reverse=True))})(?:[-_].*|\d*)", re.IGNORECASE)

#: Names that a section of an article may have for its topic, unless they end like a box of links.
_TOPICS = set("related recommended recommendations notice notices alert copyright disclaimer promotion search reply replies respond".split())
_FURNITURE = re.compile(r"[a-z]+(?:[-_](?:posts?|articles?|story|stories|links?|items?|content|news|videos?|list|box|block|widget|bar|form))*\d*", re.IGNORECASE)
#: Separators without content: between two words each kind counts once.
_RULES = {"br", "hr", "wbr", "img"}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))"""
    r"""|<(?P<raw>script|style|textarea|title|iframe|noscript|xmp|noembed|noframes|template)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"""
    r"""|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|(?P<open>\Z))|</[^>]*(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.IGNORECASE)


def _boilerplate(name: str, attrs: str, inside: bool) -> str:
    """Why an element is boilerplate, or an empty string."""
    if name in _DROP or (name == "header" and not inside):
        return name
    if not attrs:
        return ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return "hidden"
    if found.get("role", "").lower() in _ROLES:
        return "role"
    if name in _NEVER:
        return ""
    for value in (found.get("class", ""), found.get("id", "")):
        for token in value.split():
            if m := _CLASS.fullmatch(token):
                word = m[1].lower()
                if not (inside and (word in ("header", "tags", "side", "legal") or (word in _TOPICS and not _FURNITURE.fullmatch(token)))):
                    return "comment" if word.startswith(("comment", "disqus", "respond", "repl")) else word
    return ""


class _Open:
    """The open elements, with what makes each step constant time however many are open."""

    def __init__(self):
        self.stack: list[tuple[str, str, bool]] = []  # name, why dropped, inside content
        self.count: Counter[str] = Counter()
        self.blocks: list[int] = []  # places of the blocks among them

    def top(self) -> tuple[str, str, bool]:
        return self.stack[-1] if self.stack else ("", "", False)

    def add(self, name: str, why: str, inside: bool) -> None:
        if name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, why, inside))
        self.count[name] += 1

    def close(self, name: str) -> bool:
        """Close the last open element of this name and all in it; False without one."""
        if not self.count[name]:
            return False
        while True:
            last = self.stack.pop()[0]
            self.count[last] -= 1
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            if last == name:
                return True

    def block(self) -> str:
        """The innermost open block."""
        return self.stack[self.blocks[-1]][0] if self.blocks else ""


def items(page: str) -> Iterator[tuple[str, str]]:
    """(kind, text) in page order: words by zone, tags by name (inside content: inner), and gaps.

    The text of a tag that bounds a block, and of a gap, is one space.
    """
    open_ = _Open()
    has_content = re.search(r"<(?:article|main)(?=[\s/>])", page, re.IGNORECASE) is not None
    seen, at, gap = False, 0, False
    rules: set[str] = set()  # separators since the last words

    def words(text: str):
        text = entities.unescape(text)
        if not text.isspace():
            rules.clear()
        zone = ("content" if open_.top()[2] else "outside") if has_content else "plain"
        return (f"word:{zone}:{'link' if open_.count['a'] else 'text'}", text)

    for m in _TOKEN.finditer(page):
        dropped = bool(open_.top()[1])
        if m.start() > at and not dropped:
            yield words(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name or m["open"] is not None:
            continue
        if not (m["end"] or m["end2"]):
            attrs = m["attrs"] or m["attrs2"] or ""
            if name in _BLOCK and name != "br":  # an open paragraph ends at the next block, an item at the next item
                around = open_.block()
                if around == "p" or (around == name and name in ("li", "tr", "td", "th", "dd", "dt", "option")):
                    open_.close(around)
            _, why, inside = open_.top()
            if name in _CONTENT and not seen and why and why not in ("comment", "hidden"):  # a menu or advert left open
                why = ""
            why = why or _boilerplate(name, attrs, inside)
            seen |= name in _CONTENT and not why
            if name not in _VOID:
                open_.add(name, why, inside or (name in _CONTENT and not why))
            if why:
                if not gap:
                    yield "gap", " "
                gap = True
                continue
        elif not open_.close(name) or dropped:
            continue
        gap = False
        kind = f"{'inner' if open_.top()[2] else 'tag'}:{name}"
        yield "rule" if kind in rules else kind, " " if name in _BLOCK else ""
        if name in _RULES:
            rules.add(kind)
    if at < len(page) and not open_.top()[1]:
        yield words(page[at:])


# Labelled pages: what stands between [[ and ]] is the text that readers marked.
LABELLED = (
    "<html><head><title>T</title></head><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>[[Rain in the north</h1><p>It rained for nine days on end and the river rose.</p><p>People left their homes for the <a href=/h>hills</a> above the town.]]</p></article><footer>All rights reserved by us</footer></body></html>",
    "<body><div class=top><a href=/a>Start</a> | <a href=/b>Shop</a></div><div id=content><h2>[[How to bake bread</h2><p>Mix flour, water, salt and yeast, and wait until it has grown.</p><p>Bake it hot for half an hour or a little more.]]</p></div><div><a href=/c>Terms</a> <a href=/d>Privacy</a></div></body>",
    "<body><header><h1>The Daily Post</h1></header><main><h2>[[Votes are counted</h2><p>Counting went on all night in every hall of the city.</p><ul><li>North: two seats</li><li>South: three seats</li></ul><p>Results are due at noon.]]</p></main><aside>Also read this</aside></body>",
    "<body><table><tr><td><a href=/1>One</a><br><a href=/2>Two</a></td><td><p>[[An old page kept its text in a table, as pages once did.<p>It had no closing tags but could still be read by everyone.]]</td></tr></table><hr><a href=/m>Mail</a></body>",
    "<body><p>Sign in</p><article><h1>[[A short note</h1><p>Five words stand right here.]]</p></article><p>Share this page</p><p>More from us</p></body>",
    "<body><div>Menu</div><article><p>[[The first part of a longer text about birds and the way they fly.</p><div class=ad>Buy now</div><p>The second part of it tells of their nests and eggs.]]</p><footer>Filed under birds</footer></article><section id=comments><p>Nice!</p></section></body>",
    "<body><div><a href=/x>x</a> <a href=/y>y</a> <a href=/z>z</a></div><div><div><p>[[No element tells where the text begins, but it is long and has few tags.</p><blockquote>Someone said so, and others agreed with what was said.</blockquote>]]</div></div><div><ul><li><a href=/l>Link</a></li><li><a href=/k>Link</a></li></ul></div></body>",
)


def fit(pages: tuple[str, ...]) -> dict[str, float]:
    """Weights by kind of item: log-odds of lying inside the marks, words by their number."""
    inside, outside = Counter(), Counter()
    for page in pages:
        within = False
        for kind, text in items(page):
            parts = re.split(r"(\[\[|\]\])", text)
            for part in parts:
                if part in ("[[", "]]"):
                    within = part == "[["
                elif kind.startswith("word"):
                    (inside if within else outside)[kind] += len(part.split())
            if not kind.startswith(("word", "rule")):
                (inside if within else outside)[kind] += 1
    weights = {}
    for kind in inside | outside:
        odds = math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        weights[kind] = max(min(odds, 5.0), -1.5) if kind.startswith("word") else min(max(odds - 1.0, -2.5), -0.25)
    return weights


WEIGHTS = fit(LABELLED)
#: Items that no labelled page has: plain words are text, tags and gaps cost.
_DEFAULT = {"word": 1.0, "tag": -0.7, "inner": -0.25, "gap": -2.5, "rule": 0.0}


def extract(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The main text of a page."""
    if not page:
        return ""
    row = list(items(page))
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, text) in enumerate(row):
        weight = weights.get(kind, _DEFAULT[kind.partition(":")[0]])
        total += weight * len(text.split()) if kind[0] == "w" else weight
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return " ".join("".join(text for _, text in row[slice(*best_at)]).split())


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def step():
        def work(rows):
            texts = [extract(page) for page in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_rows(pages, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", step)
