"""Main text of web pages: boosted trees over the nodes of a page, then one consistent choice for the whole tree."""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import without

#: Pages that the model is fitted on at most (those with the smallest hashes), and layouts made from their texts.
FIT_PAGES = 400
LAYOUTS = 500
SEED = 11
OWN = ("text", "n_chars")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "svg", "template", "select", "button"}
_END = {tag: re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I) for tag in _RAW}
_CONTROLS = {"input", "textarea", "select", "button"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture",
    "audio", "video", "map", "object", "ruby", "rt", "rp", "nobr", "wbr", "img", "input", "br", "output", "meter", "progress",
}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_GROUPS = [
    {"article", "main", "section"}, {"div"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"},
    {"ul", "ol", "dl", "menu"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "dialog"},
    {"table", "tbody", "thead", "tr", "td", "th"}, {"#text"}, {"blockquote", "pre", "figure", "figcaption"},
]
_GROUP = {tag: k for k, tags in enumerate(_GROUPS) for tag in tags}
_HOLDER = {"article": 1, "main": 1} | dict.fromkeys(("nav", "header", "footer", "aside", "form", "dialog"), 2)
#: Tokens of class, id and role, by what they tell of. The first kind speaks for the article, the others against.
_TELLS = [
    {"article", "content", "main", "post", "entry", "story", "body", "text", "page"},
    {"nav", "menu", "navigation", "breadcrumb", "breadcrumbs", "navbar", "pagination", "pager", "toc"},
    {"header", "masthead", "head", "topbar", "logo", "brand", "hero"},
    {"footer", "foot", "copyright", "legal", "contentinfo", "colophon"},
    {"sidebar", "side", "aside", "rail", "complementary", "widget", "widgets"},
    {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense"},
    {"notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay", "warning", "message"},
    {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "commentlist", "reader"},
    {"share", "social", "follow", "related", "recommended", "more", "trending", "popular", "tags", "meta", "byline", "author"},
    {"form", "login", "search", "signup", "subscribe", "newsletter", "contact", "register", "feedback"},
]
_TELL = {token: 1 << k for k, tokens in enumerate(_TELLS) for token in tokens}
_SENTENCE = ".!?。！？"


class Page:
    """Block elements of a page in document order, each run of text between their borders as a leaf below them."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.tells: list[int] = [0]
        self.marked: list[bool] = [False]  # names of layouts: see `layout`
        self.text: list[str] = [""]
        self.linked: list[int] = [0]
        self.controls: list[int] = [0]
        self._open = [0]
        self._run: list[str] = []
        self._links = 0
        self._in_link = False
        self._read(source)
        self._flush()

    def _add(self, tag: str, more: str = "") -> int:
        tells = 0
        if more:
            for found in _ATTRIBUTE.findall(more):
                for token in _WORDS.findall("".join(found).lower()):
                    tells |= _TELL.get(token, 0)
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.tells.append(tells)
        self.marked.append("data-aside-of-layout" in more)
        self.text.append("")
        self.linked.append(0)
        self.controls.append(0)
        return len(self.tag) - 1

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                leaf = self._add("#text")
                self.text[leaf] = text
                self.linked[leaf] = min(len(text), self._links)
            self._run = []
        self._links = 0

    def _say(self, data: str) -> None:
        if "&" in data:
            data = entities.unescape(data)
        self._run.append(data)
        if self._in_link:
            self._links += len(data)

    def _close(self, tags: set[str], within: set[str]) -> None:
        """Close the innermost open element of `tags`, unless one of `within` stands inside it."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[k]]
            if tag in tags:
                self._flush()
                del self._open[k:]
                return
            if tag in within:
                return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            if not found:
                self._say(source[at:])
                return
            if found.start() > at:
                self._say(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            tag, closing = name.lower(), found[1] or found[4]
            if closing:
                self._end(tag)
                continue
            if tag in _RAW:
                if tag in _CONTROLS:
                    self.controls[self._open[-1]] += 1
                stop = _END[tag].search(source, at)
                at = stop.end() if stop else end
                continue
            self._start(tag, found[3] or found[6] or "")

    def _start(self, tag: str, more: str) -> None:
        if tag in _INLINE:
            if tag == "a":
                self._in_link = True
            elif tag in ("br", "img"):
                self._run.append(" ")
            elif tag in _CONTROLS:
                self.controls[self._open[-1]] += 1
            return
        self._flush()
        self._in_link = False
        if tag in _VOID or tag in ("html", "head", "body"):
            return
        self._close({"p"}, {"td", "th", "li", "div", "section", "article"} if tag != "p" else set())
        if tag in _CLOSES:
            for _ in range(2):
                self._close(*_CLOSES[tag])
        self._open.append(self._add(tag, more))

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        elif tag not in _INLINE:
            self._flush()
            self._in_link = False
            if tag not in _VOID:
                self._close({tag}, set())


def features(page: Page) -> np.ndarray:
    """A row for each node: kind, attribute tokens of it and above it, subtree density, depth, siblings, place."""
    n = len(page.tag)
    parent = page.parent
    sums = np.zeros((n, 6))
    depth = np.zeros(n)
    above = [0] * n
    holders = [0] * n
    order, children = [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | page.tells[p]
        holders[i] = holders[p] | _HOLDER.get(page.tag[p], 0)
        order[i] = children[p]
        children[p] += 1
        text = page.text[i]
        if text:
            sums[i] = (
                len(text), page.linked[i], text.count(" ") + 1, sum(map(text.count, _SENTENCE)), 1,
                page.tag[p] in ("p", "blockquote", "pre"),
            )
    before = np.concatenate([[0], np.cumsum(sums[:, 0])[:-1]])
    controls = np.array(page.controls, float)
    below = sums.tolist()
    forms = controls.tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        row, mine = below[p], below[i]
        for k in range(6):
            row[k] += mine[k]
        forms[p] += forms[i]
    total = np.array(below)
    up = np.maximum(parent, 0)
    chars, whole = total[:, 0], max(1.0, total[0, 0])
    safe = np.maximum(1, chars)
    blocks = np.maximum(1, total[:, 4])
    siblings = np.array(children)[up]
    kinds = np.zeros((n, len(_GROUPS)))
    at = np.array([_GROUP.get(t, -1) for t in page.tag])
    kinds[np.flatnonzero(at >= 0), at[at >= 0]] = 1
    tells, higher, held = np.array(page.tells), np.array(above), np.array(holders)
    own = np.stack([(tells >> k) & 1 for k in range(len(_TELLS))], axis=1)
    numbers = np.stack(
        [
            depth, np.log1p(chars), total[:, 1] / safe, total[:, 2] / blocks, 100 * total[:, 3] / safe, np.log1p(total[:, 4]),
            total[:, 5] / blocks, chars / whole, chars / np.maximum(1, chars[up]), before / whole,
            np.array(order) / np.maximum(1, siblings), np.log1p(siblings), np.log1p(forms), (higher & 1) > 0, (higher >> 1) > 0,
            (held & 1) > 0, (held & 2) > 0,
        ],
        axis=1,
    )
    return np.concatenate([kinds, own, numbers], axis=1).astype(np.float32)


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """Texts of the best consistent choice: what lies below a dropped node is dropped, what holds a kept one is kept."""
    n = len(page.tag)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best, none = keep.tolist(), drop.tolist()  # of a subtree: its node kept, all of it dropped
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        best[p] += max(best[i], none[i])
        none[p] += none[i]
    kept = [True] * n
    texts = []
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] > none[i]
        if kept[i] and page.text[i]:
            texts.append(page.text[i])
    return texts


def _inside(page: Page, tag: str) -> list[bool]:
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        inside[i] = page.tag[i] == tag or inside[page.parent[i]]
    return inside


def _labels(page: Page) -> np.ndarray | None:
    """Kept (in an article, or around one) or dropped, for each node of a page with an article; else null."""
    inside = _inside(page, "article")
    if not any(inside):
        return None
    around = list(inside)
    for i in range(len(around) - 1, 0, -1):
        around[page.parent[i]] |= around[i]
    return np.array(around, float)


def _named(rng: random.Random, tags: list[str], names: list[str], body: str, aside: bool = True) -> str:
    tag, name = rng.choice(tags), rng.choice(names)
    how = rng.choice(["class", "id", "class", "role"]) if name else ""
    more = f' {how}="{name}"' if name else ""
    return f"<{tag}{more}{' data-aside-of-layout' if aside else ''}>{body}</{tag}>"


def layout(rng: random.Random, texts: list[str]) -> str:
    """A page of another make around some of `texts`, what is not its article marked: menus, headers, footers,
    sidebars, notices, adverts, forms and reader comments in various elements and under various names."""
    words = [w for t in rng.sample(texts, min(5, len(texts))) for w in t.split()[:40]] or ["text"]
    say = lambda n: entities.escape(" ".join(rng.choice(words) for _ in range(n)))
    link = lambda n=2: f'<a href="/x">{say(rng.randint(1, n))}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 8))) + "</ul>"
    long = lambda: f"<p>{say(rng.randint(5, 60))}</p>"
    box = ["div", "section", "div"]
    asides = {
        "menu": lambda: _named(rng, ["nav", *box], ["", "menu", "main-nav", "navigation", "navbar top"], links()),
        "header": lambda: _named(rng, ["header", "header", "div"], ["", "header", "site-header", "masthead"], f"<h2>{say(3)}</h2>{link()}" + rng.choice(["", long(), links()])),
        "footer": lambda: _named(rng, ["footer", "footer", "div"], ["", "footer", "site-footer", "copyright"], rng.choice([f"&copy; {say(6)}", f"<p>{say(12)}</p>{links()}", long()])),
        "side": lambda: _named(rng, ["aside", "aside", "div"], ["", "sidebar", "side-widget", "right-rail"], f"<h3>{say(2)}</h3>" + rng.choice([links(), long(), long() + links()])),
        "advert": lambda: _named(rng, ["div", "aside", "section"], ["ad", "advert", "banner ad", "sponsored", "promo-box"], rng.choice([say(8), long(), link(8), f"<p>{say(20)}</p>{link()}"])),
        "notice": lambda: _named(rng, ["div", "section", "aside"], ["notice", "cookie-notice", "consent", "cookie-banner", "alert", "popup-message"], rng.choice([say(15), long(), f"<p>{say(12)}</p><button>{say(1)}</button>"])),
        "form": lambda: _named(rng, ["form", "form", "div"], ["", "newsletter", "search-form", "login", "subscribe"], f"<p>{say(8)}</p><label>{say(2)}</label><input name=q><button>{say(1)}</button>"),
        "share": lambda: _named(rng, ["div", "ul", "section"], ["share", "social", "related", "related-posts", "tags"], links()),
        "comments": lambda: _named(rng, ["section", "div", "ol", "div"], ["comments", "comment-list", "reader-comments", "discussion"], f"<h3>{say(2)}</h3>" + "".join(rng.choice([f'<div class="comment"><b>{say(1)}</b><p>{say(rng.randint(3, 40))}</p></div>', f"<p>{say(rng.randint(3, 30))}</p>", f"<li><p>{say(9)}</p></li>"]) for _ in range(rng.randint(1, 5)))),
    }
    some = lambda kinds, p: "".join(asides[k]() for k in kinds if rng.random() < p)
    body = []
    for text in texts[: rng.choice([1, 1, 2, 3, 5, 8, 12, 25])]:
        kind = rng.random()
        safe = entities.escape(text)
        body.append(f"<h2>{safe[:60]}</h2>" if kind < 0.08 else f"<ul><li>{safe}</li><li>{say(6)}</li></ul>" if kind < 0.12 else
                    f"<blockquote><p>{safe}</p></blockquote>" if kind < 0.15 else f"<p>{safe}</p>")
        if rng.random() < 0.05:
            body.append(asides[rng.choice(["advert", "share", "notice", "form", "side"])]())
    main = f"<h1>{say(6)}</h1>" * (rng.random() < 0.8) + "".join(body) + some(["share", "comments"], 0.25)
    main = _named(rng, ["article", "article", "main", "div", "section"], ["", "content", "post-body", "article", "entry-content", "main"], main, False)
    if rng.random() < 0.4:
        main = _named(rng, ["div", "main", "section"], ["", "wrapper", "container", "page"], some(["side"], 0.3) + main + some(["side", "comments"], 0.3), False)
    top, rest = ["notice", "header", "menu", "advert", "form"], ["advert", "side", "share", "comments", "form", "footer", "notice"]
    rng.shuffle(rest)
    return f"<html><head><title>{say(4)}</title></head><body>{some(top, 0.5)}{main}{some(rest, 0.45)}</body></html>"


def _layout_labels(page: Page) -> np.ndarray:
    aside = list(page.marked)
    for i in range(1, len(aside)):
        aside[i] = aside[i] or aside[page.parent[i]]
    return 1.0 - np.array(aside, float)


def fit(pages: DataFrame, rows: int = FIT_PAGES) -> Boosted:
    """Fit the trees on at most `rows` pages, and on layouts made from their texts, for which the truth is known."""
    sample = pages.select("html").where("html IS NOT NULL").orderBy(F.xxhash64(F.lit(SEED), "html"), "html").limit(rows)
    rng = random.Random(SEED)
    x, y, bodies = [], [], []
    for row in sample.toLocalIterator():
        page = Page(row["html"])
        labels = _labels(page)
        inside = _inside(page, "article") if labels is not None else [True] * len(page.tag)
        if labels is not None:
            x.append(features(page))
            y.append(labels)
        bodies.append([t for t, i in zip(page.text, inside) if t and i][:60])
    bodies = [b for b in bodies if b] or [["Some words, and more of them."] * 4]
    for _ in range(LAYOUTS):
        page = Page(layout(rng, rng.choice(bodies)))
        x.append(features(page))
        y.append(_layout_labels(page))
    return Boosted(np.concatenate(x), np.concatenate(y))


def extract(pages: DataFrame, rows: int = FIT_PAGES) -> DataFrame:
    """All rows of `pages` with text (empty if none) and n_chars, its code points.

    The model is fitted on a bounded sample of the pages; every page is read whole. Texts of kept blocks, references
    decoded and white space as single spaces, are joined by two line ends in page order. Scripts, styles, titles, form
    controls and comments in the markup are never text.

    Null and empty html give an empty text. Broken markup is read as far as it goes. Repeated rows get equal texts. An
    empty table gives an empty one. Input columns named like a result column are replaced by it.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, rows))

    def texts(column: pa.Array) -> pa.Array:
        out: list[str] = []
        held: list[Page] = []
        rows: list[np.ndarray] = []

        def settle() -> None:
            odds = shared.value.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
            at = 0
            for page in held:
                out.append("\n\n".join(decode(page, odds[at : at + len(page.tag)])))
                at += len(page.tag)
            held.clear()
            rows.clear()

        for source in column.to_pylist():
            page = Page(source or "")
            held.append(page)
            rows.append(features(page))
            if len(held) >= 200:
                settle()
        settle()
        return pa.array(out, pa.string())

    made = F.arrow_udf(texts, "string")
    return without(pages, OWN).withColumn("text", made("html")).withColumn("n_chars", F.length("text").cast("long"))
