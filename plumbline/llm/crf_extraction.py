"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed to a tree's leaf blocks: runs of text between the begins and ends of block elements, with their ancestors'
tags, class and id words. Each block has features of its ancestors, its text, its links and its place. The field has two
labels, main text and the rest, a weight a feature and one a pair of neighbouring labels; it is trained on labelled pages
by gradient steps on the exact likelihood (forward and backward sums), and a page's labels are decoded by Viterbi. Pages
are independent, so extraction is a map without a shuffle; memory is bounded by a batch of pages.

Labelled pages are HTML whose elements say by data-main="1" or "0" which blocks are main text; the innermost such element
counts, and no feature looks at it. labelled_pages() makes them in Spark from a bounded sample of the table's own words,
at most SAMPLE pages by hash of their id, MADE of them: layouts with and without semantic elements, with the parts that pages have
around articles and in them. Any other table of labelled pages will do for train().

Text: character references are decoded, white space inside a block becomes one blank, blocks are joined by line feeds.
A line break is white space. Scripts, styles, titles, templates, controls' texts and drawings are no blocks.

Defined results: null and empty pages, and pages without text, give ''; repeated rows give repeated rows; other columns are
ignored; an empty table gives no rows. Elements nested deeper than 512 count as their ancestor at that depth.
"""

from __future__ import annotations

import html
import random
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages at most whose words labelled pages are made of, how many of these are made, and steps, rate and restraint of training.
SAMPLE, MADE = 200, 1500
STEPS, RATE, L2 = 120, 0.15, 0.0005
DEPTH = 512

# Fixed values of HTML: elements that are blocks, that have no content, whose content is raw text, and whose text isn't shown as text.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript script style textarea title xmp".split())
UNSEEN = RAW | set("audio button canvas datalist math object option select svg template video".split())
#: An open element of the second kind ends where one of the first begins, up to an element of the third.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
#: Elements that an end tag of something else doesn't close.
WALLS = {"table", "td", "th", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
STRUCTURE = set("article aside footer form header main nav section".split())

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|data-main|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    linked: int
    tags: list[str]
    words: list[str]
    inner: list[str]
    kind: str
    near_form: bool
    hidden: bool
    main: bool | None


@dataclass
class _Element:
    name: str
    words: list[str] = field(default_factory=list)
    main: bool | None = None
    hidden: bool = False


class _Tree:
    """The open elements of a page and its blocks so far."""

    def __init__(self):
        self.open: list[_Element] = []
        self.deeper: dict[str, int] = {}
        self.unseen = 0
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.linked, self.links, self.paragraphs = 0, 0, 0

    def text(self, raw: str) -> None:
        if self.unseen:
            return
        said = html.unescape(raw) if "&" in raw else raw
        self.held.append(said)
        if self.links:
            self.linked += len(said)

    def flush(self) -> None:
        """Ends a block."""
        if not self.held:
            return
        said = " ".join("".join(self.held).split())
        self.held = []
        linked, self.linked = self.linked, 0
        if not said:
            return
        tags, words, inner, kind = [], [], [], ""
        near = any(e.name == "form" for e in self.open[-4:])
        for e in self.open:
            if e.name in BLOCKS:
                tags.append(e.name)
            words += e.words
            if e.words:
                inner = e.words
            if e.name in STRUCTURE:
                kind = e.name
        main = next((e.main for e in reversed(self.open) if e.main is not None), None)
        self.blocks.append(Block(said, linked, tags, words, inner, kind, near, any(e.hidden for e in self.open), main))

    def pop(self) -> None:
        gone = self.open.pop()
        self.unseen -= gone.name in UNSEEN
        self.links -= gone.name == "a"
        self.paragraphs -= gone.name == "p"

    def begin(self, name: str, rest: str) -> None:
        if name == "br":
            self.text(" ")
        if name in BLOCKS:
            self.flush()
            self.close_before(name)
        if name in VOID or name in ("svg", "math") and rest.rstrip().endswith("/"):
            return
        if name == "a" and self.links:
            self.end("a")
        if len(self.open) >= DEPTH:
            self.deeper[name] = self.deeper.get(name, 0) + 1
            return
        e = _Element(name)
        for m in _ATTRIBUTE.finditer(rest) if "=" in rest or "hidden" in rest.lower() else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "data-main":
                e.main = value == "1"
            elif key == "style":
                e.hidden |= bool(_HIDDEN.search(value))
            elif key in ("hidden", "aria-hidden"):
                e.hidden |= key == "hidden" or value.lower() == "true"
            else:
                e.words += [w.lower() for w in _WORD.findall(value)[:12] if len(w) > 1]
        self.open.append(e)
        self.unseen += name in UNSEEN
        self.links += name == "a"
        self.paragraphs += name == "p"

    def close_before(self, name: str) -> None:
        """Elements that end because this block begins: a paragraph, and what CLOSED_BY says."""
        if self.paragraphs:
            at = max(i for i, e in enumerate(self.open) if e.name == "p")
            if not any(e.name in WALLS or e.name in ("button", "object") for e in self.open[at:]):
                while len(self.open) > at:
                    self.pop()
        ends, walls = CLOSED_BY.get(name, ((), ()))
        if ends:
            at = None
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].name in ends:
                    at = i
                elif self.open[i].name in walls or self.open[i].name in WALLS - ends:
                    break
            if at is not None:
                while len(self.open) > at:
                    self.pop()

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if name == "br":
            return self.text(" ")
        if self.deeper.get(name):
            self.deeper[name] -= 1
            return None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name == name or name in HEADINGS and self.open[i].name in HEADINGS:
                while len(self.open) > i:
                    self.pop()
                return None
            if self.open[i].name in WALLS and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "template"):
                return None  # an end tag inside a cell doesn't end what the cell stands in
        return None


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order, without empty ones."""
    tree, at, end = _Tree(), 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            tree.text(page[at:])
            break
        if start > at:
            tree.text(page[at:start])
        m = _TAG.match(page, start)
        if m is None:  # a bare sign
            tree.text("<")
            at = start + 1
            continue
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            tree.end(name)
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = close.end()
        else:
            tree.begin(name, m["rest"])
    tree.flush()
    return tree.blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of each block's features."""
    count = len(blocks)
    seen = {t for b in blocks for t in b.tags}
    anchor = next((t for t in ("article", "main") if t in seen), None)
    out = []
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        share = b.linked / n
        link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3
        size = min(7, words.bit_length())
        said = b.text[-1] in ".!?…。！？:;\"”»"
        f = ["bias", f"size {size}", f"link {link}", f"size {size} link {link}", f"stops {said}", f"size {size} stops {said}", f"kind {b.kind}", f"leaf {b.tags[-1] if b.tags else ''}"]
        f += [f"in {t}" for t in set(b.tags)]
        if anchor:
            f.append(f"has {anchor} {anchor in b.tags}")
        f += [f"named {w}" for w in set(b.words)]
        f += [f"inner {w}" for w in set(b.inner)]
        f += [f"begin {w[:5]}" for w in set(b.words) if len(w) > 5]
        f.append(f"kind {b.kind} named {bool(b.inner)}")
        if b.near_form:
            f.append("near form")
        if b.hidden:
            f.append("hidden")
        if i < 2:
            f.append("at begin")
        if i == count - 1:
            f.append("at end")
        if words <= 8:
            f += [f"word {w}" for w in re.findall(r"[^\W\d_]+", b.text.lower())]
        if "©" in b.text:
            f.append("sign ©")
        if link and words <= 20 and ("|" in b.text or "·" in b.text or "»" in b.text):
            f.append("sign separator")
        out.append(f)
    return out


@dataclass(frozen=True)
class Model:
    """Weights of main text against the rest by feature; weights by pair of neighbouring labels (the rest 0, main 1)."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the most likely labels; of equals, the rest."""
        if not blocks:
            return []
        look, (stay, enter), (leave, keep) = self.weights.get, *self.pairs
        scores = [sum(look(f, 0.0) for f in own) for own in features(blocks)]
        off, on, back = 0.0, scores[0], []
        for s in scores[1:]:
            to_off, to_on = on + leave > off + stay, on + keep > off + enter
            off, on = (on + leave if to_off else off + stay), s + (on + keep if to_on else off + enter)
            back.append((to_off, to_on))
        labels = [on > off]
        for to in reversed(back):
            labels.append(to[labels[-1]])
        return labels[::-1]

    def text(self, page: str) -> str:
        blocks = blocks_of(page)
        return "\n".join(b.text for b, main in zip(blocks, self.decode(blocks), strict=True) if main)


def fit(pages: list[tuple[list[list[str]], list[bool]]], *, steps: int = STEPS, rate: float = RATE, l2: float = L2, least: int = 3) -> Model:
    """Trains on sequences of (features, labels): Adam on the likelihood's gradient, all sequences at once. Rare features don't count."""
    pages = [(f, y) for f, y in pages if f]
    if not pages:
        raise ValueError("no labelled pages")
    counts: dict[str, int] = {}
    for own, _ in pages:
        for f in {x for b in own for x in b}:
            counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= least)
    ids = {f: i for i, f in enumerate(names)}
    long, wide = max(len(f) for f, _ in pages), len(pages)
    cells, feats, truth, mask = [], [], np.zeros((long, wide)), np.zeros((long, wide))
    for j, (own, labels) in enumerate(pages):
        truth[: len(labels), j], mask[: len(labels), j] = labels, 1
        for i, b in enumerate(own):
            known = [ids[f] for f in b if f in ids]
            cells += [i * wide + j] * len(known)
            feats += known
    cells, feats = np.array(cells), np.array(feats)
    weights, pairs = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros_like(x) for x in (weights, weights, pairs, pairs)]
    seen_pairs = np.array([[((truth[:-1] == a) & (truth[1:] == b) & (mask[1:] > 0)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, steps + 1):
        score = np.bincount(cells, weights[feats], long * wide).reshape(long, wide)
        emit = np.stack([np.zeros_like(score), score], -1)
        ahead, behind = np.zeros((long, wide, 2)), np.zeros((long, wide, 2))
        ahead[0] = emit[0]
        for i in range(1, long):
            go = np.logaddexp(ahead[i - 1][:, :1] + pairs[0], ahead[i - 1][:, 1:] + pairs[1]) + emit[i]
            ahead[i] = np.where(mask[i][:, None] > 0, go, ahead[i - 1])
        for i in range(long - 2, -1, -1):
            on = behind[i + 1] + emit[i + 1]
            go = np.logaddexp(on[:, :1] + pairs[:, 0], on[:, 1:] + pairs[:, 1])
            behind[i] = np.where(mask[i + 1][:, None] > 0, go, 0.0)
        total = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
        chance = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total) * mask
        both = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(ahead[:-1, :, a] + pairs[a, b] + emit[1:, :, b] + behind[1:, :, b] - total)
                both[a, b] = (p * mask[1:]).sum()
        slope = np.bincount(feats, ((truth - chance) * mask).ravel()[cells], len(names)) / wide - l2 * weights
        slope_pairs = (seen_pairs - both) / wide - l2 * pairs
        for x, g, m, v in ((weights, slope, *moments[:2]), (pairs, slope_pairs, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    kept = {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-4}
    return Model(kept, tuple(tuple(map(float, r)) for r in pairs))


def labelled(page: str) -> tuple[list[list[str]], list[bool]]:
    """Features and labels of a labelled page."""
    blocks = blocks_of(page)
    return features(blocks), [bool(b.main) for b in blocks]


# --- labelled pages -------------------------------------------------------------------------------------------

# Names that pages give to their parts, and what these say.
NAMES = {
    "header": ["header", "site-header", "masthead", "top-bar", "topbar", "page-header", "branding", "banner-top", "logo", "site-title", "hero-header", "head"],
    "nav": ["nav", "navbar", "navigation", "menu", "main-menu", "site-nav", "top-nav", "mainnav", "nav-links", "menu-items", "primary-menu", "toolbar", "submenu"],
    "breadcrumb": ["breadcrumb", "breadcrumbs", "crumbs", "path", "you-are-here"],
    "sidebar": ["sidebar", "side", "aside", "widget", "widget-area", "right-column", "left-col", "rail", "secondary", "sidebar-box", "related", "related-posts", "recommended", "popular", "trending", "most-read", "more-stories", "tags", "tag-cloud", "archive", "about-author", "blogroll", "see-also"],
    "notice": ["cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "privacy-notice", "disclaimer", "message", "announcement", "warning", "paywall", "toast"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "adsense", "sponsored", "sponsor", "promo", "promotion", "banner", "banner-ad", "ad-container", "adbox", "google-ad", "partner", "commercial", "teaser-ad"],
    "form": ["newsletter", "subscribe", "signup", "search", "search-form", "login", "login-form", "contact-form", "subscription", "register", "poll", "survey", "feedback", "form"],
    "share": ["share", "social", "share-buttons", "social-links", "follow-us", "sharing", "print-links"],
    "comments": ["comments", "comment", "comment-list", "comment-body", "responses", "discussion", "disqus", "respond", "reply", "replies", "reader-comments", "user-comment", "thread", "guestbook"],
    "pager": ["pagination", "pager", "prev-next", "page-links", "post-navigation"],
    "footer": ["footer", "site-footer", "bottom", "colophon", "copyright", "legal", "footer-links", "imprint", "page-footer", "foot"],
    "main": ["content", "article", "post", "entry", "entry-content", "post-body", "story", "article-body", "main", "main-content", "text", "body-text", "article-text", "post-content", "story-body", "page-content", "single", "hentry", "prose", "center-column"],
    "plain": ["wrapper", "container", "row", "inner", "col", "box", "page", "layout", "grid", "block", "outer", "site", "wrap", "section", "clearfix", "module"],
}
SAYS = {
    "header": ["Welcome", "Daily News", "Official site", "Menu", "Skip to content", "Your trusted source"],
    "nav": ["Home", "About", "About us", "Contact", "News", "Sport", "Products", "Services", "Blog", "Log in", "Sign up", "Search", "Inicio", "Contacto", "Accueil", "Startseite", "Kontakt", "Archive", "FAQ", "Help"],
    "notice": ["We use cookies to improve your experience.", "This site uses cookies.", "Accept all", "Decline", "By continuing you agree to our terms.", "Read our privacy policy", "Please enable JavaScript.", "You have reached your limit of free articles.", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies."],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Shop today and save", "Limited offer", "Anzeige", "Publicité", "Publicidad", "Learn more"],
    "form": ["Subscribe to our newsletter", "Your email", "Name", "Password", "Submit", "Send", "Search", "Sign up", "Never miss a story.", "Enter your email address", "Remember me", "Forgot your password?", "Message"],
    "share": ["Share", "Tweet", "Email", "Print", "Follow us", "Share this article", "Like"],
    "comments": ["Comments", "Leave a reply", "Reply", "Leave a comment", "Post a comment", "Log in to reply", "Report", "Show more comments", "says:", "Kommentare", "Commentaires"],
    "pager": ["Previous", "Next", "Older posts", "Newer posts", "1", "2", "3", "Next page »", "« Back"],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Contact us", "Sitemap", "Powered by", "Back to top", "Impressum", "Datenschutz", "Mentions légales"],
    "sidebar": ["Related articles", "Most read", "Popular posts", "Recent posts", "Tags", "Archives", "Categories", "You may also like", "About the author", "Follow us", "More from this section", "Recommended for you"],
}
SEMANTIC = {"header": "header", "nav": "nav", "sidebar": "aside", "footer": "footer", "form": "form", "main": "article", "comments": "section", "ad": "aside", "notice": "aside", "breadcrumb": "nav", "pager": "nav", "share": "div"}


class _Maker:
    """Makes labelled pages of a pool of words."""

    def __init__(self, seed: str, words: list[str]):
        self.r, self.words = random.Random(seed), words or ["word"]
        self.semantic, self.named, self.closed = self.r.random() < 0.6, self.r.random() < 0.85, self.r.random() < 0.8
        self.inner_main = self.r.random() < 0.3

    def some(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.some(3, 22)
            out.append(html.escape(s[:1].upper() + s[1:] + self.r.choice("....!?"), quote=False))
        return " ".join(out)

    def odd(self) -> str:
        """A paragraph that doesn't read like prose: cells between strokes, words with signs, repetitions, capitals, numbers, no stop."""
        r, words = self.r, self.r.choices(self.words, k=self.r.choice([1, 4, 9, 30]))
        kind = r.random()
        if kind < 0.25:
            said = " | ".join(words) + " |"
        elif kind < 0.45:
            said = " ".join(w + r.choice(["###", "%%%", "***", "!!!", "", ";"]) for w in words)
        elif kind < 0.6:
            said = " ".join(w for w in words for _ in range(4))
        elif kind < 0.7:
            said = " ".join(words).upper()
        elif kind < 0.85:
            said = " ".join(f"{w} {r.randint(1, 9999)}" for w in words)
        else:
            said = " ".join(words)
        return html.escape(said, quote=False)

    def says(self, part: str) -> str:
        return html.escape(self.r.choice(SAYS[part]) if part in SAYS and self.r.random() < 0.6 else self.some(1, 4), quote=False)

    def element(self, part: str, inside: str, mark: str = "", tag: str | None = None) -> str:
        """A part's element: by name, by tag, or both."""
        r = self.r
        tag = tag or (SEMANTIC.get(part, "div") if self.semantic and r.random() < 0.8 else r.choice(["div", "div", "div", "section"]))
        named = ""
        if self.named and (tag in ("div", "section", "aside", "form") or r.random() < 0.4):
            own = r.sample(NAMES[part], min(len(NAMES[part]), r.randint(1, 2)))
            own += r.sample(NAMES["plain"], 1) if r.random() < 0.3 else []
            own = [r.choice([str, str.title, lambda w: w.replace("-", "_"), lambda w: w.replace("-", "")])(w) for w in own]
            named = f' class="{" ".join(own)}"' if r.random() < 0.7 else f' id="{own[0]}"'
        return f"<{tag}{named}{mark}>{inside}</{tag}>"

    def links(self, part: str, low: int, high: int) -> str:
        r, n = self.r, self.r.randint(low, high)
        items = [f'<a href="/{i}">{self.says(part)}</a>' for i in range(n)]
        style = r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.closed else f"<li>{x}" for x in items) + "</ul>"
        return r.choice([" | ", " ", " · "]).join(items) if style < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def heading(self, part: str) -> str:
        level = self.r.randint(2, 4)
        return f"<h{level}>{self.says(part)}</h{level}>"

    def part(self, part: str) -> str:
        r = self.r
        prose = f"<p>{self.sentences(1, 4)}</p>" if r.random() < 0.6 else self.sentences(1, 3)
        if part in ("nav", "breadcrumb", "share", "pager"):
            inside = self.links(part, 2, 8)
        elif part == "header":
            inside = r.choice([f"<a href='/'>{self.says(part)}</a>", f"<div>{self.says(part)}</div>", f"<h1>{self.says(part)}</h1>", f"<p>{self.sentences(1, 1)}</p>"]) + (self.links("nav", 2, 6) if r.random() < 0.5 else "")
        elif part == "sidebar":
            inside = "".join(self.heading(part) + r.choice([prose, self.links("sidebar", 2, 7)]) for _ in range(r.randint(1, 3)))
        elif part == "form":
            fields = "".join(r.choice([f"<label>{self.says(part)}</label><input name=a>", f"<p>{self.says(part)} <input></p>", f"<button>{self.says(part)}</button>", f"<div>{self.says(part)}</div><textarea></textarea>"]) for _ in range(r.randint(1, 4)))
            inside = (self.heading(part) if r.random() < 0.5 else "") + (prose if r.random() < 0.5 else "") + fields
            inside = f"<form action='/x'>{inside}</form>" if not self.semantic or r.random() < 0.7 else inside
        elif part == "comments":
            one = lambda: self.element("comments", r.choice(["", f"<b>{self.some(1, 2)}</b> ", f"<div>{self.some(1, 2)} {r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 24)}</div>"]) + "".join(f"<p>{self.sentences(1, 5)}</p>" for _ in range(r.randint(1, 3))) + (f"<a href='#'>{self.says(part)}</a>" if r.random() < 0.4 else ""), tag=r.choice(["div", "li", "article" if self.semantic else "div"]))
            inside = self.heading(part) + "".join(one() for _ in range(r.randint(1, 5)))
        elif part == "footer":
            inside = r.choice([f"&copy; {r.randint(2001, 2025)} {self.some(1, 3)}", f"&copy; {self.some(1, 2)} &middot; {self.sentences(1, 2)}", prose, f"<p>&copy; {self.some(1, 2)} {self.says(part)}</p>"]) + (self.links("footer", 2, 6) if r.random() < 0.5 else "")
        else:  # notices and adverts
            inside = r.choice([prose, self.says(part), f"<p>{self.says(part)}</p>{prose}", f"<h3>{self.says(part)}</h3>{prose}", f"<a href='/x'>{self.sentences(1, 1)}</a>"])
        return self.element(part, inside, ' data-main="0"' + (' style="display:none"' if part == "notice" and r.random() < 0.2 else ""))

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{html.escape(self.some(1, 10), quote=False)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.5:
                out.append(f"<p>{self.sentences(1, r.choice([1, 2, 6, 14]))}</p>" if self.closed else f"<p>{self.sentences(1, 6)}")
            elif kind < 0.6:
                out.append(f"<p><b>{self.sentences(1, 4)}<br>" if r.random() < 0.5 else f"<p><b>{self.some(1, 5)}</b> {self.sentences(1, 3)} <a href='/y'>{self.some(1, 3)}</a> {self.sentences(1, 2)}</p>")
            elif kind < 0.64:
                out.append(f"<p>{html.escape(self.some(1, 2), quote=False)}.</p>")
            elif kind < 0.68:
                out.append(f"<p>{self.odd()}</p>")
            elif kind < 0.76:
                out.append(f"<h{r.randint(2, 4)}>{html.escape(self.some(1, 6), quote=False)}</h2>")
            elif kind < 0.84:
                out.append(r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{self.sentences(1, 2)}</li>" if r.random() < 0.6 else f"<li>{html.escape(self.some(1, 6), quote=False)}</li>" for _ in range(r.randint(2, 6)))))
            elif kind < 0.88:
                out.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(self.sentences(1, 3))}</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(self.some(1, 4), quote=False)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x alt=''><figcaption>{self.sentences(1, 1)}</figcaption></figure>" if self.semantic else f"<pre>{html.escape(self.some(3, 20), quote=False)}</pre>")
            else:
                out.append(f"<div>{self.sentences(1, 4)}</div>")
        for part in r.choices(["ad", "share", "sidebar", "form", "comments", "notice"], weights=[4, 2, 2, 2, 2, 1], k=r.choice([0, 0, 1, 2, 3])):
            out.insert(len(out) if part == "comments" else r.randint(0, len(out)), self.part(part))
        return self.element("main", "".join(out), ' data-main="1"', tag="main" if self.semantic and r.random() < 0.15 else None)

    def page(self) -> str:
        r = self.r
        before = [self.part(p) for p in ["notice", "header", "nav", "breadcrumb", "ad", "form", "share"] if r.random() < 0.45]
        after = [self.part(p) for p in ["share", "ad", "comments", "sidebar", "pager", "form", "footer", "notice"] if r.random() < 0.45]
        if r.random() < 0.3:
            before.append(self.part("sidebar"))
        inside = self.article()
        if self.inner_main:
            moved = after[: r.randint(0, len(after))]
            inside = self.element("plain", inside + "".join(moved), tag="main" if self.semantic and "<main" not in inside else "div")
            after = after[len(moved) :]
        body = "".join(before) + inside + "".join(after)
        if r.random() < 0.4:
            body = self.element("plain", body, tag="div")
        if r.random() < 0.04:
            body = f"<form id='aspnetForm'><div><div><div>{body}</div></div></div></form>"
        return f"<!DOCTYPE html><html><head><title>{self.some(1, 5)}</title></head><body>{body}</body></html>"


def labelled_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE, made: int = MADE) -> DataFrame:
    """html: `made` labelled pages (up to a page a source more) of the words of at most `sample` pages, those of the smallest hashes of their ids."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).where("length(html) > 0")
    chosen = [r["page_id"] for r in own.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]  # ids alone: every task sends its own smallest
    few, each = own.where(F.col("page_id").isin(chosen)).limit(sample), -(-made // max(1, len(chosen)))

    @common.tidy
    def run(batches):
        for batch in batches:
            out = []
            for page_id, page in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                words = " ".join(b.text for b in blocks_of(page)).split()[:4000]
                out += [_Maker(f"{page_id} {i}", [w.strip(".,!?|·©") or "word" for w in words]).page() for i in range(each)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["html"])

    return few.mapInArrow(run, "html string")


def train(pages: DataFrame, *, html_col: str = "html", most: int = MADE + SAMPLE, **settings) -> Model:
    """A model of labelled pages; of more than `most` of them, those with the smallest hashes."""
    rows = pages.select(F.col(html_col).alias("html")).where("html is not null").orderBy(F.xxhash64("html"), "html").limit(most).collect()
    return fit([labelled(r["html"]) for r in rows], **settings)


def extract(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""
    common.arrow_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    call, sent = uuid.uuid4().hex, pages.sparkSession.sparkContext.broadcast(model)

    @common.tidy
    def run(batches):
        known = common.worker_state(call, lambda: sent.value)
        for batch in batches:
            texts = [known.text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op12_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    made = labelled_pages(pages)
    try:
        model = train(made)
    except ValueError:  # no page has text: there is nothing to extract
        model = Model({}, ((0.0, 0.0), (0.0, 0.0)))
    return extract(pages, model)
