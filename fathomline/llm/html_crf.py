"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A forgiving scan of the tags keeps a stack of open elements; text between block boundaries is a leaf block, described by
its own tag, its ancestors' tags and class and id words, and features of its text. The field has weights for the features
and for neighbouring labels; it is trained on labelled pages by gradient ascent on the conditional log likelihood
(forward-backward) and decoded by Viterbi.

By default the labelled pages are made here: layouts drawn at random from common page structures, with each block's label
known. Other labelled pages can be given.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import blocks

#: Attributes up to the tag's end: a quote counts right after `=` and if it is closed; possessive, so that time is linear.
_REST = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+>""")
_COMMENT = re.compile(r"</>|<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_TOKEN = re.compile(r"[a-z]+")

# Element names of HTML by their role.
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template svg math iframe object textarea title select canvas audio video head".split())
#: Of these the content is not markup either.
UNPARSED = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var img input wbr".split())
#: A start tag that ends an open element of the second kind (unless one of the third stands between).
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SECTIONS = ("article", "nav", "aside", "footer", "header", "main", "form", "section", "body")
#: What may stand in a head; anything else begins the body.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Start tags that end open graphics and choices that were not closed.
BREAKS_OUT = frozenset("article aside blockquote body center dd div dl dt footer form h1 h2 h3 h4 h5 h6 header li main menu nav ol p pre section table ul".split())


@dataclass
class Block:
    """A leaf block: its text and the features of its place and text."""

    text: str
    features: list[str] = field(default_factory=list)


def _words_of(tag: str) -> list[str]:
    """The words of a tag's class, id and role, and whether it is hidden."""
    out: list[str] = []
    for name, value in _ATTRIBUTE.findall(tag, _NAME.match(tag).end()):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value):
            out.append("!hidden")
        elif name in ("class", "id", "role"):
            out += _TOKEN.findall(value)
    return out


class Open:
    """The open elements, with what is asked of them kept up to date, so that depth costs nothing."""

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.stack: list[tuple[str, list[str]]] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[str] = []
        self.sections: list[str] = []
        self.raw = 0
        self.about: dict[str, int] = {}  # features of the open elements, and how many of them have each

    def _features(self, name: str, words: list[str]) -> list[str]:
        own = [f"word={w}" for w in words]
        if name not in INLINE and name != "html":
            own.append(f"in={name}")
        return own if self.known is None else [f for f in own if f in self.known]

    def push(self, name: str, words: list[str]) -> None:
        self.where.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, words))
        if name not in INLINE and name != "html":
            self.blocks.append(name)
        if name in SECTIONS:
            self.sections.append(name)
        self.raw += name in RAW
        for f in self._features(name, words):
            self.about[f] = self.about.get(f, 0) + 1

    def last(self, *names: str) -> int:
        """The place of the innermost of these, or -1."""
        return max((at[-1] for n in names if (at := self.where.get(n))), default=-1)

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            name, words = self.stack.pop()
            self.where[name].pop()
            if name not in INLINE and name != "html":
                self.blocks.pop()
            if name in SECTIONS:
                self.sections.pop()
            self.raw -= name in RAW
            for f in self._features(name, words):
                self.about[f] -= 1
                if not self.about[f]:
                    del self.about[f]


class Tags:
    """The tags of a page one by one, in time linear in it.

    Quotes count right after `=` only. A tag that its quotes would keep open to the end of the page ends at its first `>`,
    as do all after it; without any it ends the page."""

    def __init__(self, page: str):
        self.page, self.trusted = page, True

    def after(self, at: int) -> tuple[int, int, str] | None:
        """Start, end and lower-case name of the next tag (comments and declarations: no name)."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if m := _COMMENT.match(page, at):
                return at, m.end(), ""
            if m := _NAME.match(page, at):
                end = _REST.match(page, m.end()) if self.trusted else None
                if end:
                    return at, end.end(), m.group(1).lower()
                self.trusted = False
                close = page.find(">", m.end())
                return at, close + 1 if close >= 0 else len(page), m.group(1).lower()
            at += 1
        return None


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The page's leaf blocks in order, with their features; with `known`, those among it only."""
    now = Open(known)
    out: list[Block] = []
    text: list[str] = []
    linked = at = 0
    unending: set[str] = set()  # elements without a further end tag

    def flush() -> None:
        nonlocal linked
        body = " ".join("".join(text).split())
        if body:
            out.append(Block(body, _features(body, now, linked)))
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not now.raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if now.where.get("a"):
                linked += len(raw.strip())

    tags = Tags(page)
    while found := tags.after(at):
        start, stop, name = found
        add(page[at:start])
        at = stop
        if not name:
            continue
        tag = page[start:stop]
        if tag[1] == "/":
            place = now.last(name)
            if place >= 0:
                if name not in INLINE:
                    flush()
                now.pop_to(place)
            elif name == "p":
                flush()
            elif name == "br":
                add(" ")
            continue
        if name == "br":
            add(" ")
            continue
        closed = tag.endswith("/>") and "=" not in tag[max(tag.rfind(c) for c in " \t\n\r\f\"'") + 1 :]
        if name in UNPARSED and not closed:
            if name not in INLINE:
                flush()
            end = None if name in unending else re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                unending.add(name)
                if name in ("script", "style"):
                    at = len(page)
            continue
        if now.raw:
            if name not in IN_HEAD and (place := now.last("head")) >= 0 or name in BREAKS_OUT and (place := now.last("svg", "math", "select")) >= 0:
                now.pop_to(place)
        if name not in INLINE:
            flush()
            if (place := now.last("p")) >= 0 and not now.raw:
                now.pop_to(place)
            if name in CLOSES:
                what, until = (x.split() for x in CLOSES[name])
                edge = now.last(*until)
                while (place := now.last(*what)) > edge:
                    now.pop_to(place)
                    if name != "tr":
                        break
        if name not in VOID and not closed:
            now.push(name, _words_of(tag))
    add(page[at:])
    flush()
    for i, b in enumerate(out):
        b.features += [f"at={min(i, 3)}", f"from_end={min(len(out) - 1 - i, 3)}"]
    return out


def _features(body: str, now: Open, linked: int) -> list[str]:
    section, own = (x[-1] if x else "none" for x in (now.sections, now.blocks))
    out = {"bias", f"tag={own}", f"section={section}", *now.about, *(f"near={w}" for _, ws in now.stack[-2:] for w in ws)}
    n, share = len(body), linked / max(1, len(body))
    out.add(f"size={min(9, n.bit_length())}")
    out.add(f"links={0 if share < 0.05 else 1 if share < 0.5 else 2}")
    out.add(f"ends={'.' if body[-1] in '.!?…' else ':' if body[-1] in ':;' else 'no'}")
    if "©" in body or "(c)" in body.lower():
        out.add("copyright")
    if sum(c.isdigit() for c in body) * 5 > n:
        out.add("digits")
    if "," in body:
        out.add("comma")
    return sorted(out)


def _labelled(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """One made page and the labels of its leaf blocks."""
    labels: list[bool] = []

    def words(lo: int, hi: int) -> str:
        sizes = rng.integers(1, 9, int(rng.integers(lo, hi + 1)))
        letters = iter("aeinorstlmudéü"[i] for i in rng.integers(0, 14, int(sizes.sum())))
        return " ".join("".join(next(letters) for _ in range(k)) for k in sizes).capitalize()

    def one(*choices: str) -> str:
        return str(rng.choice(choices))

    def mark(tag: str, inner: str, words_in: str = "") -> str:
        return f"<{tag}{f' {one("class", "id")}="{words_in}"' if words_in else ''}>{inner}</{tag}>"

    def leaf(label: bool, tag: str, text: str) -> str:
        labels.append(label)
        return mark(tag, text)

    def linked(n: int) -> str:
        return "".join(leaf(False, "li", f'<a href="/{i}">{words(1, 3)}</a>') for i in range(n))

    def boilerplate(kind: str) -> str:
        if kind == "nav":
            if rng.random() < 0.6:
                return mark("nav", mark("ul", linked(int(rng.integers(2, 9)))), one("", "main", "site"))
            return mark("div", mark("ul", linked(int(rng.integers(2, 9)))), one("nav", "menu", "navbar", "navigation", "breadcrumbs", "breadcrumb", "pagination", "toc", "top-menu", "main-menu"))
        if kind == "header":
            inner = lambda: leaf(False, one("div", "h1", "p", "span"), words(1, 6))
            return mark("header", inner()) if rng.random() < 0.5 else mark("div", leaf(False, "div", words(1, 6)), one("header", "masthead", "site-header", "topbar", "logo", "branding"))
        if kind == "footer":
            body = one("&copy; ", "© 2020 ", "") + words(2, 9) + one(".", " &middot; " + words(5, 12) + ".", "")
            if rng.random() < 0.6:
                labels.append(False)
                return f"<footer>{body}</footer>"
            return mark("div", leaf(False, one("p", "div"), body), one("footer", "site-footer", "copyright", "legal", "colophon", "bottom"))
        if kind == "ad":
            labels.append(False)
            words_in = one("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "ad-slot", "banner", "promotion")
            return f'<!-- ad --><{(t := one("div", "aside", "section", "p"))} class="{words_in}">{words(3, 16)}.</{t}>'
        if kind == "side":
            n = int(rng.integers(1, 4))
            inner = leaf(False, one("h2", "h3", "h4"), words(1, 4)) + ("".join(leaf(False, "p", words(4, 22) + ".") for _ in range(n)) if rng.random() < 0.5 else mark("ul", linked(n)))
            return mark("aside", inner) if rng.random() < 0.5 else mark("div", inner, one("sidebar", "side", "related", "widget", "rail", "recommended", "popular", "trending", "more", "aside", "links"))
        if kind == "notice":
            inner = leaf(False, one("p", "div", "span"), words(5, 25) + ".") + (leaf(False, "button", words(1, 2)) if rng.random() < 0.5 else "")
            return mark(one("div", "section"), inner, one("cookie", "cookies", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall", "warning"))
        if kind == "form":
            labels.append(False)
            return f'<form action="/s">{words(1, 8)} <input name="q"><select><option>x</option></select></form>' if rng.random() < 0.6 else mark("div", mark("form", words(2, 8)), one("search", "login", "signup", "contact"))
        if kind == "share":
            return mark(one("div", "ul"), linked(int(rng.integers(2, 5))), one("share", "social", "follow", "tags", "sharing"))
        n = int(rng.integers(1, 5))
        inner = leaf(False, one("h2", "h3"), words(1, 3)) + "".join((mark("div", leaf(False, one("p", "div"), words(3, 40) + one(".", "!", "")), one("comment", "reply", "comment-body", "")) for _ in range(n)))
        return mark(one("div", "section", "ol"), inner, one("comments", "comment", "replies", "discussion", "responses", "disqus", "comment-list", "respond"))

    def paragraph() -> str:
        r = rng.random()
        body = words(1, 90) + one(".", ".", ".", "!", "?", "")
        if r < 0.1:
            labels.append(True)
            return f"<p><b>{body}<br>"
        if r < 0.2:
            labels.append(True)
            return f"<p>{body} <a href='/x'>{words(1, 3)}</a>, {words(2, 9)}."
        if r < 0.27:
            return mark(one("ul", "ol"), "".join(leaf(True, "li", words(2, 20) + one(".", ";", "")) for _ in range(int(rng.integers(2, 5)))))
        if r < 0.32:
            return leaf(True, one("h2", "h3"), words(1, 6))
        if r < 0.36:
            return leaf(True, one("blockquote", "pre", "figcaption", "td"), body)
        return leaf(True, one("p", "p", "p", "p", "div"), body)

    def article() -> str:
        out = leaf(True, one("h1", "h1", "h2"), words(1, 10)) if rng.random() < 0.9 else ""
        for _ in range(int(rng.integers(1, 14))):
            if rng.random() < 0.07:
                out += boilerplate(one("ad", "side", "share", "notice", "ad"))
            out += paragraph()
        if rng.random() < 0.1:
            out += boilerplate("comments")
        r = rng.random()
        if r < 0.6:
            return f"<article>{out}</article>"
        if r < 0.75:
            return mark("main", mark("article", out) if rng.random() < 0.4 else out)
        return mark("div", out, one("content", "article", "post", "entry", "story", "article-body", "entry-content", "main", "text", "post-content", "body"))

    before = [k for k, p in (("notice", 0.2), ("header", 0.4), ("nav", 0.75), ("ad", 0.5), ("form", 0.2), ("side", 0.15)) if rng.random() < p]
    after = [k for k, p in (("share", 0.2), ("comments", 0.3), ("side", 0.3), ("ad", 0.25), ("form", 0.1), ("nav", 0.1), ("footer", 0.8), ("notice", 0.15)) if rng.random() < p]
    body = "".join(map(boilerplate, before)) + article() + "".join(map(boilerplate, after))
    head = f"<head><title>{words(2, 6)}</title><style>p{{a:b}}</style><script>var x='<p>';</script></head>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html>{head}<body>{body}" + one("</body></html>", ""), labels


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """Made pages as blocks and labels; those whose blocks don't come out as made (neighbouring bare text) are left out."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        page, labels = _labelled(rng)
        found = leaf_blocks(page)
        if len(found) == len(labels):
            out.append((found, labels))
    return out


@dataclass
class Field:
    """Weights of features for label 1 (label 0 has none), of the first label, and of (label, next label)."""

    weights: dict[str, float]
    first: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi; of equals label 0."""
        back: list[tuple[int, int]] = []
        a, b = self.first
        for i, block in enumerate(blocks):
            e = sum(self.weights.get(f, 0.0) for f in block.features)
            if i:
                (s00, s01), (s10, s11) = self.step
                back.append((int(b + s10 > a + s00), int(b + s11 > a + s01)))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11)
            b += e
        out = [int(b > a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return [bool(x) for x in reversed(out)][: len(blocks)]


def fit(pages: list[tuple[list[Block], list[bool]]], rounds: int = 150, ridge: float = 1e-4) -> Field:
    """Maximise the mean conditional log likelihood per block, by Adam on the whole batch."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Field({}, (0.0, 0.0), ((0.0, 0.0), (0.0, 0.0)))
    names = sorted({f for blocks, _ in pages for b in blocks for f in b.features})
    at = {f: i for i, f in enumerate(names)}
    longest, total = max(len(b) for b, _ in pages), sum(len(b) for b, _ in pages)
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y, real = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for p, (blocks, labels) in enumerate(pages):
        for t, (b, label) in enumerate(zip(blocks, labels, strict=True)):
            x[p, t, [at[f] for f in b.features]] = 1
            y[p, t], real[p, t] = label, True
    hot = np.eye(2)[y]
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    flat = x.reshape(-1, len(names))
    for step in range(1, rounds + 1):
        w, first, move = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        e = np.zeros((*y.shape, 2))
        e[..., 1] = (flat @ w.astype(np.float32)).reshape(y.shape)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + first
        for t in range(1, longest):
            fwd[:, t] = np.where(real[:, t, None], np.logaddexp.reduce(fwd[:, t - 1, :, None] + move, axis=1) + e[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(real[:, t + 1, None], np.logaddexp.reduce(move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        gamma = np.exp(fwd + bwd - z[:, None, None]) * real[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + move + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        seen = hot[:, :-1, :, None] * hot[:, 1:, None, :] * real[:, 1:, None, None]
        gap = (hot * real[..., None] - gamma)[..., 1].reshape(-1).astype(np.float32)
        grad = np.concatenate([flat.T @ gap, (hot - gamma)[:, 0].sum(0), (seen - pair).sum((0, 1)).ravel()]) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, rest = theta[:-6], [float(t) for t in theta[-6:]]
    return Field({f: float(w[i]) for f, i in at.items()}, (rest[0], rest[1]), ((rest[2], rest[3]), (rest[4], rest[5])))


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(labelled_pages())


def main_text(page: str, model: Field) -> str:
    found = leaf_blocks(page, model.weights)
    return " ".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Field | None = None) -> DataFrame:
    """The columns `keep`, text (the main blocks joined by a space; empty if none) and n_chars of each row.

    Null html is empty and a page without blocks has an empty text; broken markup is read on as `Tags` says, but an unclosed
    comment, script or style ends the page; repeated rows come out alike. A page of any length is held by one task, in time
    linear in it."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_field())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in blocks(batch, html)):
            texts = [main_text(t.as_py() or "", shared.value) for t in b.column(html)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return pages.select(*keep, html).mapInArrow(each, f"{kinds}, text string, n_chars bigint")
